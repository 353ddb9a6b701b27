"""The life of notes, the exchange of tables, the facade and streams of notes."""

import json

import pytest
from pyspark.sql import functions as F

from noesis.api import Memory
from noesis.functions.plugins import HashingEncoder, KnownEntities, encoded
from noesis.operators import lifecycle as L
from noesis.sources import exchange
from noesis.streaming.ingest import Trigger, added, drain, log_windows

NODES = "id long, content string, category string, timestamp timestamp, embedding array<float>, last_accessed timestamp, access_count int, importance string, emotional_tone string, emotional_intensity int, emotional_reflection string, t_event_start timestamp, t_event_end timestamp, temporal_expressions array<string>, tags string"
EDGES = "source_id long, target_id long, weight double, edge_type string, created_at timestamp"
NOW = "2025-06-15 12:00:00"


@pytest.fixture(scope="module")
def tables(spark):
    text = ["the night job renamed the old table", "a docker host failed twice in spring", "we kept the weights for the review", "plan the trip to the coast"]
    n = spark.createDataFrame([(k + 1, t, "general", None, None, 0, "normal", "") for k, t in enumerate(text)], "id long, content string, category string, timestamp timestamp, last_accessed timestamp, access_count int, importance string, tags string")
    n = n.withColumn("timestamp", F.lit("2025-01-01 00:00:00").cast("timestamp") + F.make_interval(days=F.col("id").cast("int"))).withColumn("embedding", encoded(HashingEncoder())(F.col("content")))
    shape = spark.createDataFrame([], NODES).schema
    n = n.select(*[(F.col(f.name) if f.name in n.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape])
    return {
        "nodes": n, "edges": spark.createDataFrame([(1, 2, 0.5, "semantic", None)], EDGES), "entities": spark.createDataFrame([(1, "docker", "tech")], "id long, name string, entity_type string"),
        "node_entities": spark.createDataFrame([(2, 1)], "node_id long, entity_id long"),
    }


@pytest.fixture
def memory(spark, tables):
    return Memory(spark, encoder=HashingEncoder(), tables=tables)


def test_add_note(memory):
    out = memory.add_note([{"content": "a new docker host came on 2025-02-03", "importance": "URGENT"}, {"content": "the night job renamed the old table"}, {"content": "a new docker host came on 2025-02-03"}], now=NOW)
    new = out["nodes"].filter("id > 4").collect()
    assert [(r.id, r.content, r.importance, r.category, str(r.timestamp), str(r.t_event_start)) for r in new] == [(5, "a new docker host came on 2025-02-03", "normal", "general", NOW, "2025-02-03 00:00:00")]
    assert memory.add_note([{"content": "the night job renamed the old table"}], now=NOW, force=True)["nodes"].count() == 5
    again = memory.after(out).add_note([{"content": "quite another thing"}], now=NOW)
    assert again["nodes"].count() == 6


def test_added_links(spark, tables):
    from noesis.plans.registry import Store
    from noesis.plans.upkeep import State

    t = State(Store(spark, ""))
    t.own.update(tables)
    batch = spark.createDataFrame([("a docker host failed twice in autumn",)], "content string").withColumn("embedding", encoded(HashingEncoder())(F.col("content")))
    out = added(t, batch, now=NOW, extractor=KnownEntities())
    kinds = {(r.source_id, r.target_id, r.edge_type) for r in out["edges"].collect()}
    assert {(5, 2, "semantic"), (2, 5, "semantic"), (5, 2, "entity"), (2, 5, "entity"), (5, 2, "consolidation")} <= kinds
    assert {(r.node_id, r.entity_id) for r in out["node_entities"].collect()} == {(2, 1), (5, 1)}


def test_versions(spark, memory):
    one = memory.update_note(spark.createDataFrame([(1, "first change", None), (2, None, "critical")], "id long, content string, importance string"), now="2025-06-01 00:00:00")
    m = memory.after(one)
    assert {r.id: (r.content, r.importance) for r in one["nodes"].filter("id < 3").collect()} == {1: ("first change", "normal"), 2: ("a docker host failed twice in spring", "critical")}
    for k in range(6):
        m = m.after(m.update_note(spark.createDataFrame([(1, f"change {k}")], "id long, content string"), now="2025-06-02 00:00:00"))
    ids = spark.createDataFrame([(1,)], "id long")
    assert [r.version_number for r in m.get_note_history(ids).collect()] == [7, 6, 5, 4, 3]
    back = m.restore_note_version(spark.createDataFrame([(1, 3)], "note_id long, version_number int"), now=NOW)
    assert back["nodes"].filter("id = 1").first().content == "change 0"
    assert m.after(back).get_note_history(ids).first().content == "change 5"
    same = m.restore_note_version(spark.createDataFrame([(1, 99)], "note_id long, version_number int"), now=NOW)
    assert same["nodes"].filter("id = 1").first().content == "change 5"


def test_verbs(spark, memory):
    ids = spark.createDataFrame([(2,)], "id long")
    gone = memory.delete_note(ids)
    assert (gone["nodes"].count(), gone["edges"].count(), gone["node_entities"].count()) == (3, 0, 0)
    assert memory.set_importance(ids, "low")["nodes"].filter("importance = 'low'").count() == 1
    with pytest.raises(ValueError):
        memory.set_importance(ids, "huge")
    e = memory.add_edge(spark.createDataFrame([(1, 2, "semantic", 0.9), (3, 4, None, None)], "source_id long, target_id long, edge_type string, weight double"), now=NOW)["edges"]
    assert {(r.source_id, r.target_id, r.edge_type, r.weight) for r in e.collect()} == {(1, 2, "semantic", 0.9), (3, 4, "related_to", 0.7)}
    p = memory.add_anchor_policy(spark.createDataFrame([(" Skill ", "keep"), ("skill", "x"), ("log", None)], "category string, description string"), now=NOW)
    m = memory.after(p)
    assert [r.category for r in m.list_anchor_policies().collect()] == ["log", "skill"]
    assert m.remove_anchor_policy(spark.createDataFrame([("LOG",)], "category string"))["anchor_policies"].count() == 1
    assert [r.node_id for r in memory.find_similar("night job table", k=1, least=0.1).collect()] == [1]
    assert [r.dst for r in memory.get_graph(ids).collect()] == [1]
    assert memory.get(3).first().content.startswith("we kept") and memory.get_memory("general", "all").count() == 4
    i = memory.add_intention("water the plants", now=NOW, due="2025-06-01")
    row = i["nodes"].filter("category = 'prospective'").first()
    assert row.tags == "prospective pending due:2025-06-01"
    done = memory.after(i).complete_intention(spark.createDataFrame([(row.id, "done at noon")], "id long, note string"))["nodes"].filter(f"id = {row.id}").first()
    assert done.tags == "prospective done due:2025-06-01" and done.content.endswith("Completed: done at noon")
    j = memory.update_working_memory("first entry", now="2025-06-01 00:00:00")
    k = memory.after(j).update_working_memory("second entry", now=NOW)
    assert k["edges"].filter("edge_type = 'temporal_chain' and source_id = 6 and target_id = 5").count() == 1
    assert [r.content for r in memory.after(k).get_session_context().collect()] == ["second entry", "first entry"]
    seen, out = memory.ingest_skill(spark.createDataFrame([("# Mend\n\ntags: a b", "s.md")], "text string, source string"), now=NOW, confirmed=True)
    assert seen.first().status == "ingested" and out["nodes"].filter("category = 'skill' and importance = 'low'").count() == 1
    blocks = memory.extract_remember_blocks(spark.createDataFrame([(1, "[REMEMBER: k=v]text[/REMEMBER]")], "n long, text string")).first()
    assert (blocks.n, blocks.body, blocks.attributes) == (1, "text", {"k": "v"})


def test_search_and_log(spark, memory, tmp_path):
    found = memory.logged_search("docker host", now=NOW, log=str(tmp_path / "log"))
    assert found.orderBy("place").first().node_id == 2
    assert memory.search_stats(str(tmp_path / "log"), day="2025-06-15").first().searches == 1
    shown = memory.search_memory("docker host", now=NOW, detail="brief", most=1)
    assert (shown.count(), shown.first().has_more) == (1, True)
    assert memory.search_memory("docker host", now=NOW, category="none").count() == 0
    assert [r.node_id for r in memory.search_memory("docker host", now=NOW, entity_type="tech").collect()] == [2]
    assert memory.search_memory("docker host last week", now=NOW).count() == 0


def test_parts_and_tags(spark):
    notes = spark.createDataFrame([(1, "accuracy 91.1% and rate: 20 ms " * 4, "general", "critical"), (2, "short", "skill", "normal"), (3, " ".join(f"Sentence number {k} stands here." for k in range(30)), "lc-chunk", None)], "id long, content string, category string, importance string")
    a, links = L.keyword_anchors(notes)
    assert [(r.parent, r.content, r.tags) for r in a.collect()] == [(1, "KEY: accuracy 91.1% | rate: 20", "anchor parent-1 cat-general")] and links.first().weight == 0.9
    parts, chain = L.chunks(notes, parents=False)
    assert parts.filter("parent = 3").count() == chain.filter("parent = 3").count() + 1 and parts.filter("parent = 2").count() == 0
    names = spark.createDataFrame([(7, "Big Data Lab"), (8, "ab")], "id long, name string")
    t = {r.id: r.tags for r in L.tags(notes, spark.createDataFrame([(1, 7), (1, 8)], "node_id long, entity_id long"), names).collect()}
    assert t[1].split()[:2] == ["critical", "big-data-lab"] and len(t[1].split()) <= 6 and t[2].split()[0] == "skill"


def test_entities(spark):
    e = spark.createDataFrame([(3, "machine learning", "concept"), (9, "Docker", "tech")], "id long, name string, entity_type string")
    found = spark.createDataFrame([("ML", None), ("docker", "Tech"), ("docker", "place"), (" ", "x")], "name string, entity_type string")
    every, ids = L.entity_ids(e, found)
    assert {(r.name, r.entity_type): r.entity_id for r in ids.collect()} == {("ML", None): 3, ("docker", "Tech"): 9, ("docker", "place"): 10} and every.count() == 3


def test_exchange(spark, tmp_path):
    base = str(tmp_path / "base")
    spark.createDataFrame([(1, "note", [1.0])], "id long, content string, embedding array<float>").write.parquet(f"{base}/nodes.parquet")
    spark.createDataFrame([(1, 2)], "source_id long, target_id long").write.parquet(f"{base}/edges.parquet")
    spark.createDataFrame([(1, "e")], "id long, name string").write.parquet(f"{base}/entities.parquet")
    spark.createDataFrame([(1, 1)], "node_id long, entity_id long").write.parquet(f"{base}/node_entities.parquet")
    assert exchange.export_json(spark, base, str(tmp_path / "out")) == {"nodes": 1, "edges": 1, "entities": 1, "node_entities": 1}
    assert "embedding" not in spark.read.json(str(tmp_path / "out/nodes")).columns
    assert json.loads(spark.read.text(str(tmp_path / "out/manifest")).first()[0])["counts"]["edges"] == 1
    for k in range(4):
        left = exchange.snapshot(spark, base, str(tmp_path / "snaps"), keep=2, name=f"v{k}")
    assert left == ["v2", "v3"] and spark.read.parquet(exchange.restore(str(tmp_path / "snaps"), "v2") + "/nodes.parquet").count() == 1
    (tmp_path / "skills.json").write_text(json.dumps([{"name": "mend", "purpose": "mends", "tags": ["a", "b"]}, {"name": "note", "purpose": "x"}]))
    skills = exchange.import_skills(spark, str(tmp_path / "skills.json"), spark.createDataFrame([("my note",)], "content string")).collect()
    assert [(r.content, r.category, r.tags) for r in skills] == [("SKILL LEARNED: mend\n\nPurpose: mends\n\nTags: a, b", "general", "a b")]
    d = tmp_path / "md/tools/fix"
    d.mkdir(parents=True)
    (d / "SKILL.md").write_text("# Fix tables\n" + "This is a long line about fixing tables of all kinds.\n" * 2)
    r = exchange.read_markdown(spark, str(tmp_path / "md")).first()
    assert (r.category, r.name) == ("tools", "Fix tables") and r.purpose.startswith("This is a long line")
    exchange.write_skills(exchange.read_markdown(spark, str(tmp_path / "md")), str(tmp_path / "skills-out"))
    assert spark.read.json(str(tmp_path / "skills-out")).first().name == "Fix tables"


def test_dialogues(spark, tmp_path):
    turn = lambda s, k: {"speaker": s, "dia_id": f"D{k}", "text": f"line {k}" if k != 3 else ""}
    talk = {"conversation": {"speaker_a": "A", "speaker_b": "B", "session_1": [turn("AB"[k % 2], k) for k in range(6)], "session_1_date_time": "May", "session_2": [turn("A", 9)]}, "qa": [{"question": "q", "answer": "a", "category": 2, "evidence": ["D1"]}]}
    (tmp_path / "d.json").write_text(json.dumps([talk]))
    turns, qa = exchange.read_dialogues(spark, str(tmp_path / "d.json"))
    assert turns.count() == 7 and qa.first().evidence == ["D1"]
    parts = {(r.session, r.part): (r.text, r.dia_ids) for r in exchange.conversations(turns).collect()}
    assert parts == {(1, 0): ("A: line 0\nB: line 1\nA: line 2", ["D0", "D1", "D2"]), (1, 1): ("A: line 4\nB: line 5", ["D4", "D5"]), (2, 0): ("A: line 9", ["D9"])}
    assert exchange.conversations(turns, "session").count() == 2 and exchange.conversations(turns, "turn").count() == 6
    exchange.write_results(qa, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().answer == "a"


def test_streams_of_notes(spark, tables, tmp_path):
    from noesis.plans.registry import Store
    from noesis.plans.upkeep import State
    from noesis.streaming.ingest import ingest_whole

    batch = spark.createDataFrame([("an entirely new thought",), ("the night job renamed the old table",)], "content string").withColumn("embedding", encoded(HashingEncoder())(F.col("content")))
    batch.write.parquet(str(tmp_path / "in"))
    state = State(Store(spark, ""))
    state.own.update(tables)
    slept = []
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))

    def write(out, epoch):
        for name, df in out.items():
            state.put(name, df)

    q = ingest_whole(stream, lambda: state, write, str(tmp_path / "cp"), now=lambda: NOW, trigger=Trigger(notes=1, hours=0), sleep=slept.append).start()
    q.awaitTermination(120)
    assert q.exception() is None and slept == [NOW]
    assert [r.content for r in state.nodes.filter("id > 4").collect()] == ["an entirely new thought"]
    drain(stream, str(tmp_path / "out"), str(tmp_path / "cp2")).start().awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    log = spark.createDataFrame([("2025-01-01 01:00:00", 0, 4.0), ("2025-01-01 02:00:00", 3, 8.0)], "timestamp string, results_count int, latency_total_ms double").withColumn("timestamp", F.to_timestamp("timestamp"))
    r = log_windows(log).first()
    assert (r.searches, r.zero_results, r.mean_ms, r.most_ms) == (2, 1, 6.0, 8.0)


def test_trigger():
    t = Trigger(50, 6)
    assert t.due(50, "2025-01-01 00:00:00", "2025-01-01 01:00:00") and t.due(0, "2025-01-01 00:00:00", "2025-01-01 06:00:00") and not t.due(49, "2025-01-01 00:00:00", "2025-01-01 05:59:00")
    assert not Trigger(50, 0).due(0, None, "2025-01-01 00:00:00") and t.due(0, None, "2025-01-01 00:00:00")
