import random

import pyarrow as pa

from noesis.operators.packed import explode_packed, split_block, split_field


def test_rules():
    assert split_field("a, b;c|d\te\nf") == ["a", "b", "c", "d", "e", "f"]
    assert split_field("a  b c") == ["a", "b", "c"]
    assert split_field('"x, y", z') == ["x, y", "z"]
    assert split_field('"so ""late"" edge",done') == ['so "late" edge', "done"]
    assert split_field('one "two three" four') == ["one", "two three", "four"]
    assert split_field('["a, b", " c ", "", null, 3]') == ["a, b", "c", "3"]
    assert split_field(",, a ,") == ["a"]
    assert split_field('5" disk, x') == ['5" disk', "x"]
    assert split_field("[broken") == ["[broken"]
    assert split_field(None) == split_field("") == split_field("  ") == []


def test_block_equals_single_fields():
    r = random.Random(7)
    fields = ["".join(r.choice('ab,;" |"\t [\xa0é\n') for _ in range(r.randrange(16))) for _ in range(20_000)] + [None, "", "x" * 100_000 + ",y"]
    parents, at, values = split_block(pa.array(fields, pa.string()))
    got = [[] for _ in fields]
    for p, k, v in zip(parents, at, values.to_pylist()):
        assert len(got[p]) == k
        got[p].append(v)
    assert got == [split_field(f) for f in fields]


def test_frame(spark, rows):
    df = spark.createDataFrame([(1, "b, a, a", "x"), (2, None, "y"), (3, "", "z"), (1, "b, a, a", "x")], "id long, tags string, pos string")
    assert rows(explode_packed(df, "id", "tags")) == sorted([(1, 0, "b"), (1, 1, "a"), (1, 2, "a")] * 2)
    assert explode_packed(df.limit(0), "id", "tags").count() == 0
