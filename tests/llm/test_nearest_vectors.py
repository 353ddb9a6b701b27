import numpy as np
from pyspark.sql import functions as F

from noesis.llm import nearest_vectors as V

SCHEMA = "id long, embedding array<float>, cell int, rep long"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2) for i, v in rows], SCHEMA)


def test_recall_and_exact_cosines(spark):
    r = np.random.default_rng(2)
    centre = r.standard_normal((300, 32))
    v = np.repeat(centre, 8, axis=0) + 0.25 * r.standard_normal((2400, 32))
    got = {(x.a, x.b): x.cosine for x in V.nearest_vectors(frame(spark, list(enumerate(v))), "id", "embedding", k=5, dim=32, least=0.8).collect()}
    u = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).astype(float)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    want = {(a, int(b)) for a in range(len(u)) for b in np.argsort(-s[a])[:5] if s[a, b] >= 0.8}
    assert len(want & set(got)) >= 0.97 * len(want)
    assert all(abs(c - s[a, b]) < 1e-5 for (a, b), c in got.items())


def test_unusable_ties_and_copies(spark):
    e = [1.0] + [0.0] * 7
    rows = [(1, None), (2, e[:5]), (3, [0.0] * 8), (4, [float("nan")] + e[1:]), (5, [None, *e[1:]]), (6, [float("inf")] + e[1:]), *[(10 + k, e) for k in range(9)], (30, [2.0] + e[1:]), (40, [0.0, 1.0] + e[2:])]
    got = sorted((x.a, x.b, x.place) for x in V.nearest_vectors(frame(spark, rows), "id", "embedding", k=3, dim=8, least=0.8).collect())
    ids = [*range(10, 19), 30]
    assert got == sorted((a, b, k + 1) for a in ids for k, b in enumerate([x for x in ids if x != a][:3]))
    assert V.nearest_vectors(frame(spark, rows).limit(0), "id", "embedding", dim=8).count() == 0


def test_split_and_dense_cells(spark):
    """More cells than coarse centroids, and cells dealt into parts, give the same neighbours; asking rows only ask."""
    r = np.random.default_rng(5)
    centre = r.standard_normal((120, 16))
    v = np.repeat(centre, 6, axis=0) + 0.2 * r.standard_normal((720, 16))
    df = frame(spark, list(enumerate(v)))
    u = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).astype(float)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    want = {(a, int(b)) for a in range(len(u)) for b in np.argsort(-s[a])[:4] if s[a, b] >= 0.8}
    for setting in ({"cell": 20, "coarse": 6}, {"cell": 200, "dense": 60}):
        rows = V.nearest_vectors(df, "id", "embedding", k=4, dim=16, least=0.8, spill=4, **setting).collect()
        got = {(x.a, x.b) for x in rows}
        assert len(rows) == len(got) and len(want & got) >= 0.97 * len(want)
    few = V.nearest_vectors(df, "id", "embedding", k=4, dim=16, least=-1.0, asking=F.col("id") % 100 == 0, probe=36, cell=20).collect()
    assert {x.a for x in few} == set(range(0, 720, 100))
    best = {(a, int(b)) for a in range(0, 720, 100) for b in np.argsort(-s[a])[:4]}
    assert len(best & {(x.a, x.b) for x in few}) >= 0.95 * len(best)


def test_codes():
    r = np.random.default_rng(0)
    x = r.standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    flat, aware = V.Codebook.fit(x, 1.0), V.Codebook.fit(x, 8.0)
    along = lambda b: (((x - b.decode(b.encode(x))) * x).sum(1) ** 2).mean()
    assert along(aware) < along(flat)  # less error parallel to the vector
    codes = aware.encode(x)
    assert (V.unpack(V.pack(codes)) == codes).all()
    rough, real = aware.scan(x[:40], V.pack(codes)), aware.decode(codes) @ x[:40].T
    assert all(np.corrcoef(rough[:, k], real[:, k])[0, 1] > 0.999 for k in range(40))
