from noesis.operators import references as R


def frames(spark):
    edges = spark.createDataFrame(
        [(1, 9, "s", "2024-01-05 00:00:00"), (1, 9, "s", "2024-01-03 00:00:00"), (1, 2, "s", None), (8, 2, "t", "2024-02-01 00:00:00"), (None, 2, None, None), (2, 1, "s", "2020-01-01 00:00:00")],
        "source_id long, target_id long, edge_type string, created_at string",
    ).selectExpr("source_id", "target_id", "edge_type", "cast(created_at as timestamp) created_at")
    nodes = spark.createDataFrame([(1, "2023-01-01 00:00:00"), (2, None)], "id long, at string").selectExpr("id", "cast(at as timestamp) at")
    gone = spark.createDataFrame([(9,), (9,), (1,)], "ref_id long")
    return edges, nodes, gone


def test_reasons(spark, rows):
    edges, nodes, gone = frames(spark)
    got = rows(R.orphans(R.edge_references(edges), nodes, gone))
    assert got == sorted([
        ("edges", "target_id", "1|9|s", 9, "2024-01", "deleted"),
        ("edges", "source_id", "8|2|t", 8, "2024-02", "missing"),
        ("edges", "target_id", "2|1|s", 1, "2020-01", "late"),
    ])


def test_counts_agree(spark):
    edges, nodes, gone = frames(spark)
    refs = R.edge_references(edges)
    assert R.orphan_counts(refs, nodes, gone).groupBy().sum("orphans").first()[0] == R.orphans(refs, nodes, gone).count()


def test_counts_within_the_month(spark):
    """References of the record's own month are compared by the instant, others by the month; the same sums as row by row."""
    stamps = ["2024-03-01 00:00:00", "2024-03-09 00:00:00", "2024-03-10 00:00:01", "2024-02-28 00:00:00", "2024-04-01 00:00:00", None]
    edges = spark.createDataFrame([(5, k, "s", s) for k, s in enumerate(stamps)] + [(5, 100 + k, "s", stamps[1]) for k in range(900)], "source_id long, target_id long, edge_type string, c string").selectExpr("source_id", "target_id", "edge_type", "cast(c as timestamp) created_at")
    nodes = spark.sql("select 5L id, timestamp'2024-03-10 00:00:00' at")
    refs = R.edge_references(edges).filter("ref_field = 'source_id'")
    got = {(r.period, r.reason): r.orphans for r in R.orphan_counts(refs, nodes, nodes.selectExpr("id as ref_id").limit(0)).collect()}
    assert got == {("2024-03", "late"): 902, ("2024-02", "late"): 1}
    want = {(r.period, r.reason): r["count"] for r in R.orphans(refs, nodes, nodes.selectExpr("id as ref_id").limit(0)).groupBy("period", "reason").count().collect()}
    assert got == want


def test_empty_and_hot_key(spark):
    edges, nodes, gone = frames(spark)
    assert R.orphans(R.edge_references(edges.limit(0)), nodes, gone).count() == 0
    assert R.orphans(R.edge_references(edges), nodes.limit(0), gone.limit(0)).filter("reason = 'missing'").count() == 9
    hot = spark.range(3000).selectExpr("7 source_id", "id + 100 target_id", "'x' edge_type", "cast(null as timestamp) created_at")
    assert R.orphans(R.edge_references(hot), nodes, gone).filter("ref_field = 'source_id' and ref_id = 7").count() == 3000
