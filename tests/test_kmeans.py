"""k-means by matrix products."""

import numpy as np

from noesis.operators import kmeans


def test_planted_groups_are_found(spark):
    r = np.random.default_rng(6)
    c = np.eye(16)[:12]
    v = np.concatenate([x + 0.02 * r.standard_normal((30, 16)) for x in c])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    got = {n: dict(kmeans.fit(df.repartition(n), 12, dim=16).collect()) for n in (1, 5)}
    assert got[1] == got[5] and got[1].keys() == set(range(len(v)))
    assert {frozenset(i for i, t in got[1].items() if t == x) for x in set(got[1].values())} == {frozenset(range(30 * g, 30 * g + 30)) for g in range(12)}


def test_more_centroids_than_directions(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 2.0]) for i in range(40)], "id long, embedding array<double>")
    got = dict(kmeans.fit(df, 7, dim=2).collect())
    assert len(got) == 40 and len({got[i] for i in range(0, 40, 2)}) == 1 and got[0] != got[1]
    assert kmeans.fit(df.limit(0), 3, dim=2).count() == 0
