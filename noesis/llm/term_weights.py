"""How distinctive a term is of a record: residual inverse document frequency.

Of a collection of ``n`` records with at least one term, ``df`` of them holding a term ``cf`` times in all, the inverse
document frequency log2(n / df) is compared with what a Poisson process of the same collection frequency would show,
-log2(1 - exp(-cf / n)). The residual is near zero for terms strewn at random and large for terms packed into few
records; times the frequency in the record it is the term's ``score`` there. ``rarity`` = ln((n+1)/(df+1)) / ln(n+1) and
``share`` = frequency / length of the record are given beside it.

Plan: terms are taken out JVM-side once, with one row more per text that carries its number of terms, added up per
(record, term) with map-side combination, and written once; the statistics, the number of records, their lengths and the
scores all read that table. Common terms do not skew anything: statistics combine map-side and the join back is on the
aggregate.

Which terms mark a record strongly is chosen by the residual: a caller's condition on share and rarity bounds from above
the number of records a case's term can be in, so it bounds from below the residual it must reach (``residual_floor``).
Terms below their floor, the common ones strewn over the collection, fall out; the exact condition follows on the rest.

Defined cases: null, empty and blank texts have no terms and do not count as records; texts are taken whole; repeated
rows of one id add up to one record, terms and length alike; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noesis.session import cut

TERM = r"([\p{L}\p{N}_]+)"


def terms_of(text: str, least_chars: int):
    """Lower-cased maximal runs of letters, digits and underscores of at least ``least_chars`` characters."""
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(rf"([\p{{L}}\p{{N}}_]{{{least_chars},}})"), F.lit(1))


def counted_terms(df: DataFrame, key: str, text: str, least_chars: int) -> DataFrame:
    """``record_id, term, tf`` of every record, and its length as the ``tf`` of the empty term; written once."""
    found = df.select(F.col(key).alias("record_id"), terms_of(text, least_chars).alias("terms")).filter(F.size("terms") > 0)
    rows = found.select("record_id", F.size("terms").alias("size"), F.explode(F.array_append("terms", F.lit(""))).alias("term"))
    weight = F.when(F.col("term") == "", F.col("size")).otherwise(F.lit(1))
    return cut(rows.groupBy("record_id", "term").agg(F.sum(weight).alias("tf")), "terms")


def residual(df: Column, cf: Column, n: Column) -> Column:
    """Observed minus expected inverse document frequency."""
    return F.log2(n / df) + F.log2(-F.expm1(-cf / n))


def residual_floor(rarity: Column, tf: Column, n: Column) -> Column:
    """The least residual of a term of at least this rarity that a record holds ``tf`` times. The rarity bounds its number
    of records by ``most``, its collection frequency is at least that number + tf - 1, and the residual falls with the
    number of records and grows with the frequency."""
    most = F.greatest(F.pow(n + 1, 1 - rarity) - 1, F.lit(1.0))
    return residual(most, most + tf - 1, n) - 1e-9


def term_weights(df: DataFrame, key: str, text: str, *, least_chars: int = 3, least_share: float = 0.0, least_length: int = 1) -> DataFrame:
    """``record_id, term, tf, length, df, cf, n, share, rarity, ridf, score`` for every term of every record.

    ``least_share`` and ``least_length`` are exact bounds of the caller's condition on the record alone: they keep rows from
    the join with the statistics and never touch the statistics. No row passes both with fewer occurrences than their
    product."""
    per = counted_terms(df, key, text, least_chars)
    terms, lengths = per.filter("term <> ''"), per.filter("term = ''").select("record_id", F.col("tf").alias("length"))
    stats = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    size = lengths.agg(F.count(F.lit(1)).alias("n"))
    scored = terms.filter(F.col("tf") >= least_share * least_length).join(lengths.filter(F.col("length") >= least_length), "record_id")
    scored = scored.filter(F.col("tf") >= F.col("length") * least_share)
    n, d = F.col("n").cast("double"), F.col("df").cast("double")
    return (
        scored.join(stats, "term").crossJoin(F.broadcast(size))
        .withColumn("share", F.col("tf") / F.col("length"))
        .withColumn("rarity", F.log((n + 1) / (d + 1)) / F.log(n + 1))
        .withColumn("ridf", residual(d, F.col("cf").cast("double"), n))
        .withColumn("score", F.col("ridf") * F.col("tf"))
        .select("record_id", "term", "tf", "length", "df", "cf", "n", "share", "rarity", "ridf", "score")
    )


def _marking(w: DataFrame, rarity: Column) -> DataFrame:
    """Terms whose residual score reaches what a term of the given rarity must have."""
    n, tf = F.col("n").cast("double"), F.col("tf").cast("double")
    return w.filter(F.col("score") >= tf * residual_floor(rarity, tf, n))


def distinctive_note_terms(nodes: DataFrame, *, share_rarity: float = 0.06, least_terms: int = 20) -> DataFrame:
    """Terms of notes whose residual score reaches the floor of a case, with share x rarity of at least the bound. As rarity
    is below 1, only terms whose share alone reaches the bound can be cases."""
    w = term_weights(nodes, "id", "content", least_share=share_rarity, least_length=least_terms)
    return _marking(w, F.lit(share_rarity) / F.col("share")).filter(F.col("share") * F.col("rarity") >= share_rarity)


def distinctive_summary_terms(summaries: DataFrame, *, rarity: float = 0.75) -> DataFrame:
    """Terms of cluster summaries whose residual score reaches the floor of the given rarity, with that rarity."""
    w = term_weights(summaries, "id", "top_terms")
    return _marking(w, F.lit(rarity)).filter(F.col("rarity") >= rarity)
