"""Measures of retrieval and of answers, and sweeps over their parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noesis.functions import text


def hits(found: DataFrame, wanted: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, hit, rank``: whether one of the wanted notes (query_id, node_id) is among the first ``k`` places, and the
    best place of all, null without. Every query of ``wanted`` has a row."""
    best = found.join(wanted.select("query_id", "node_id").distinct(), ["query_id", "node_id"], "left_semi").groupBy("query_id").agg(F.min("place").alias("rank"))
    return wanted.select("query_id").distinct().join(best, "query_id", "left").withColumn("hit", F.coalesce(F.col("rank") <= k, F.lit(False)))


def passage_hits(found: DataFrame, notes: DataFrame, evidence: DataFrame, *, k: int = 5, chars: int = 50) -> DataFrame:
    """As ``hits``, where a note counts if it holds the first ``chars`` characters of the query's evidence (query_id, text),
    in any case."""
    rows = found.join(notes.select(F.col("id").alias("node_id"), F.lower("content").alias("_c")), "node_id").join(evidence.select("query_id", F.lower(F.substring("text", 1, chars)).alias("_e")), "query_id")
    holding = rows.filter((F.col("_e") != "") & F.contains("_c", "_e"))
    best = holding.groupBy("query_id").agg(F.min("place").alias("rank"))
    return evidence.select("query_id").distinct().join(best, "query_id", "left").withColumn("hit", F.coalesce(F.col("rank") <= k, F.lit(False)))


def recall_and_rank(judged: DataFrame, group: str) -> DataFrame:
    """``group, level, queries, hits, recall, mrr`` per group and over all (level 1, group ``*``), of rows (hit, rank)."""
    rows = judged.select(F.col(group).alias("_g"), F.col("hit").cast("int").alias("h"), F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("r"))
    out = rows.rollup("_g").agg(F.grouping("_g").cast("int").alias("level"), F.count(F.lit(1)).alias("queries"), F.sum("h").alias("hits"), F.avg("h").alias("recall"), F.avg("r").alias("mrr"))
    return out.select(F.when(F.col("level") == 1, "*").otherwise(F.col("_g")).alias(group), "level", "queries", "hits", "recall", "mrr")


def keyword_hits(found: DataFrame, notes: DataFrame, keywords: DataFrame, *, k: int = 5) -> DataFrame:
    """``query_id, hit``: whether one of the query's keywords (query_id, keywords array) is part of a note among the first
    ``k``, in any case."""
    rows = found.filter(F.col("place") <= k).join(notes.select(F.col("id").alias("node_id"), F.lower("content").alias("_c")), "node_id").join(keywords, "query_id")
    some = rows.groupBy("query_id").agg(F.max(F.exists("keywords", lambda w: F.contains(F.col("_c"), F.lower(w)))).alias("hit"))
    return keywords.select("query_id").distinct().join(some, "query_id", "left").select("query_id", F.coalesce("hit", F.lit(False)).alias("hit"))


def regression(found: DataFrame, expected: DataFrame, *, k: int = 5, least: float = 0.6) -> DataFrame:
    """One row of ``hits, expected, precision, critical_misses, passed`` for expected notes (query_id, node_id, critical): a
    run passes with no critical note missing and at least ``least`` of all found."""
    seen = found.filter(F.col("place") <= k).select("query_id", "node_id").distinct().withColumn("_s", F.lit(True))
    rows = expected.join(seen, ["query_id", "node_id"], "left")
    got = F.count_if(F.col("_s"))
    lost = F.count_if(F.col("_s").isNull() & F.coalesce("critical", F.lit(False)))
    share = F.coalesce(F.try_divide(got, F.count(F.lit(1))), F.lit(0.0))
    return rows.agg(got.alias("hits"), F.count(F.lit(1)).alias("expected"), share.alias("precision"), lost.alias("critical_misses"), ((lost == 0) & (share >= least)).alias("passed"))


def answer_scores(pairs: DataFrame, key: str, answer: Column | str, truth: Column | str) -> DataFrame:
    """``key, f1, rouge1, exact``: F1 over the multisets of words, share of the true words that the answer has, and
    equality, all after ``text.plain``. An answer or truth without words scores 0, two such are equal."""
    plain = lambda c: F.coalesce(text.plain(c), F.lit(""))
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    p = pairs.select(F.col(key).alias("_k"), plain(answer).alias("a"), plain(truth).alias("t")).withColumn("_row", F.monotonically_increasing_id())
    sides = p.select("_k", "_row", F.lit(1).alias("s"), F.explode(words("a")).alias("w")).unionByName(p.select("_k", "_row", F.lit(0).alias("s"), F.explode(words("t")).alias("w")))
    per = sides.groupBy("_k", "_row", "w").agg(F.sum("s").alias("x"), F.sum(1 - F.col("s")).alias("y"))
    sums = per.groupBy("_k", "_row").agg(F.sum(F.least("x", "y")).alias("both"), F.sum("x").alias("na"), F.sum("y").alias("nt"))
    precision, recall = F.try_divide("both", "na"), F.try_divide("both", "nt")
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    texts = p.groupBy("_k").agg(F.max((F.col("a") == F.col("t")).cast("int")).alias("exact"))
    scored = sums.groupBy("_k").agg(F.max(f1).alias("f1"), F.max(F.coalesce(recall, F.lit(0.0))).alias("rouge1"))
    return texts.join(scored, "_k", "left").select(F.col("_k").alias(key), F.coalesce("f1", F.lit(0.0)).alias("f1"), F.coalesce("rouge1", F.lit(0.0)).alias("rouge1"), "exact")


def sweep(signals: DataFrame, settings: DataFrame, wanted: DataFrame, *, k: int = 5) -> DataFrame:
    """``setting, queries, recall, mrr`` of every setting (setting, alpha, beta, gamma), from signals computed once
    (query_id, node_id, semantic, spread, words): only the blend is done anew. Settings are a stated list, joined to every
    row of the candidates."""
    scored = signals.crossJoin(F.broadcast(settings)).withColumn("score", F.col("semantic") * F.col("alpha") + F.col("spread") * F.col("beta") + F.col("words") * F.col("gamma"))
    w = Window.partitionBy("setting", "query_id").orderBy(F.desc(F.round("score", 9)), "node_id")
    placed = scored.withColumn("place", F.row_number().over(w))
    best = placed.join(wanted.select("query_id", "node_id").distinct(), ["query_id", "node_id"], "left_semi").groupBy("setting", "query_id").agg(F.min("place").alias("rank"))
    every = settings.select("setting").crossJoin(F.broadcast(wanted.select("query_id").distinct()))
    rows = every.join(best, ["setting", "query_id"], "left")
    return rows.groupBy("setting").agg(F.count(F.lit(1)).alias("queries"), F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))).alias("recall"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def questions(notes: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """``id, strategy, question``: a question per note without a model: about its first entity (smallest id) masked in a
    sentence that names it, else about a date or number it holds, else its first sentence."""
    first = links.select("node_id", "entity_id").join(entities.select(F.col("id").alias("entity_id"), "name", "entity_type"), "entity_id").groupBy("node_id").agg(F.min(F.struct("entity_id", "name", "entity_type")).alias("e"))
    n = notes.filter(F.length(F.trim("content")) > 0).join(first.withColumnRenamed("node_id", "id"), "id", "left")
    russian = F.length(F.regexp_replace("content", "[^а-яА-ЯёЁ]", "")) > F.length(F.regexp_replace("content", "[^a-zA-Z]", ""))
    said = F.filter(F.transform(F.split("content", r"[.!?\n]"), lambda x: F.trim(x)), lambda x: F.contains(F.lower(x), F.lower(F.col("e.name"))) & (F.length(x) > 20))
    # a sentence that does not begin with the name asks better
    inner = F.filter(said, lambda x: (F.length(x) > 30) & ~F.startswith(F.lower(x), F.lower(F.col("e.name"))))
    chosen = F.coalesce(F.try_element_at(inner, F.lit(1)), F.try_element_at(said, F.lit(1)))
    place = F.expr("locate(lower(e.name), lower(_chosen))")
    n = n.withColumn("_chosen", chosen).withColumn("_at", place)
    masked = F.concat(F.expr("substring(_chosen, 1, _at - 1)"), F.lit("[?]"), F.expr("substring(_chosen, _at + length(e.name))"))
    ask = lambda en, ru: F.when(russian, F.lit(ru)).otherwise(F.lit(en))
    kind = F.lower(F.trim("e.entity_type"))
    lead = F.when(kind == "person", ask("Who is mentioned: ", "Кто упоминается здесь: ")).when(kind == "tech", ask("Which tool or system: ", "Какой инструмент: ")).when(kind == "concept", ask("What concept: ", "О каком понятии: ")).otherwise(ask("What does this refer to: ", "О чём идёт речь: "))
    entity = F.when((F.col("_at") > 0) & (F.length(masked) > 20), F.concat(lead, masked))
    date = F.regexp_extract("content", r"(?U)\b(20\d\d|January|February|March|April|May|June|July|August|September|October|November|December)\b", 1)
    number = F.regexp_extract("content", r"(?U)\b(\d+\.?\d*\s?%|\d{3,})", 1)
    keyword = F.when(date != "", F.concat(ask("What happened in ", "Что произошло в "), date, F.lit("?"))).when(number != "", F.concat(ask("What does ", "Что означает "), number, ask(" refer to?", " в этом контексте?")))
    plain = F.concat(ask("What is said about: ", "Что сказано о: "), text.first_sentence("content"))
    strategy = F.when(entity.isNotNull(), "entity").when(keyword.isNotNull(), "keyword").otherwise("sentence")
    return n.select("id", strategy.alias("strategy"), F.coalesce(entity, keyword, plain).alias("question"))
