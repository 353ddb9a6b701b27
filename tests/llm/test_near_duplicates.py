import random

from noesis.llm import near_duplicates as N
from noesis.llm.words import words

SCHEMA = "id long, content string, a string, rep string"


def brute(rows, width, threshold):
    sets = {}
    for i, t in rows:
        w = words(t)
        s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
        if s:
            sets[i] = s
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def notes(n=250, seed=4):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        if k % 3 and rows:
            w = r.choice(rows)[1].split()
            for _ in range(r.randrange(4)):
                at = r.randrange(len(w))
                w[at : at + r.randrange(2)] = [f"new{r.randrange(50)}"]
            rows.append((k, " ".join(w)))
        else:
            rows.append((k, " ".join(f"w{r.randrange(400)}" for _ in range(r.randrange(20, 90)))))
    return rows


def test_against_brute_force(spark):
    for width, threshold in ((3, 0.6), (5, 0.8)):
        rows = notes()
        df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
        got = {(r.a, r.b) for r in N.near_duplicates(df, "id", "content", threshold=threshold, width=width).collect()}
        want = brute(rows, width, threshold)
        assert want and got <= want and len(want - got) <= 0.01 * len(want)


def test_odd_inputs(spark):
    long = " ".join(f"word{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "two words"), (5, "One, two; three!"), (6, "one two three"), (6, "one two three"), (7, long), (8, long + " tail")]
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    got = {(r.a, r.b) for r in N.near_duplicates(df, "id", "content", threshold=0.6, width=3).collect()}
    assert got == {(5, 6), (7, 8)}
    assert N.near_duplicates(df.limit(0), "id", "content").count() == 0


def test_hot_copies(spark):
    """A third of all rows with one text: every copy is linked to the smallest id, nothing is squared."""
    rows = [(k, "the same old note about the memory graph") for k in range(400)] + [(1000 + k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(800)] + [(5000, "the same old note about the memory graph again")]
    df = spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)
    got = {(r.a, r.b) for r in N.near_duplicates(df, "id", "content", threshold=0.6, width=3).collect()}
    assert got == {(0, k) for k in range(1, 400)} | {(0, 5000)}


def test_subsets_at_the_threshold(spark):
    """15 of 25 sequences: the size filter lets pairs at exactly 0.6 through."""
    text = lambda k, n: " ".join(f"p{k}w{j}" for j in range(n))
    rows = [r for k in range(40) for r in ((2 * k, text(k, 17)), (2 * k + 1, text(k, 27)))]
    df = spark.createDataFrame(rows, "id long, content string")
    got = {(r.a, r.b) for r in N.near_duplicates(df, "id", "content", threshold=0.6, width=3).collect()}
    assert got <= {(2 * k, 2 * k + 1) for k in range(40)} and len(got) >= 36


def test_large_class_of_different_texts(spark):
    """Records of one set but different texts all meet; only same texts stand behind one id."""
    rows = [(k, "the same old note about the memory graph" + "!" * k) for k in range(40)] + [(100 + k, "The same old note about the memory graph") for k in range(50)] + [(500, "the same old note about the memory graph again")]
    got = [(r.a, r.b) for r in N.near_duplicates(spark.createDataFrame(rows, "id long, content string"), "id", "content", threshold=0.6, width=3).collect()]
    units = [*range(40), 100, 500]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in units for b in units if a < b} | {(100, 100 + k) for k in range(1, 50)}


def test_groups_for_threshold():
    g = N.groups_for(0.6)
    assert 1 - (1 - 0.6**N.GROUP) ** g >= N.RECALL


def test_low_threshold_and_hot_entries(spark):
    """Any threshold has its hash functions; entries above the hot bound are paired chunk by chunk."""
    rows = notes(120, 9)
    df = spark.createDataFrame(rows, "id long, content string")
    got = {(r.a, r.b) for r in N.near_duplicates(df, "id", "content", threshold=0.4, width=3).collect()}
    assert got == brute(rows, 3, 0.4)
    rows = [(k, f"the same old note about the memory graph of all the machines in the house number {k}") for k in range(60)]
    df = spark.createDataFrame(rows, "id long, content string")
    got = [(r.a, r.b) for r in N.near_duplicates(df, "id", "content", threshold=0.6, width=3, hot=8).collect()]
    assert len(got) == len(set(got)) == 60 * 59 // 2


def test_membership(spark):
    rows = [(1, "one two three four five"), (2, "One two, three four five!"), (3, "one two three four five six"), (4, "something else with other words here"), (4, "something else with other words here"), (5, None)]
    df = spark.createDataFrame(rows, "id long, content string")
    got = sorted(tuple(r) for r in N.linked_classes(df, "id", "content", threshold=0.6, width=3).collect())
    assert got == [(1, 1, 2, 2), (2, 1, 2, 2), (3, 3, 1, 2), (4, 4, 1, 0)]


def test_several_texts_of_one_id(spark):
    rows = [(1, "red green blue"), (1, "cold warm hot"), (2, "red green blue"), (3, "cold warm hot")]
    df = spark.createDataFrame(rows, "id long, content string")
    got = [(r.a, r.b) for r in N.near_duplicates(df, "id", "content", threshold=0.6, width=3).collect()]
    assert got in ([(1, 2)], [(1, 3)])
