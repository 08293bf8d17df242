"""Mixing sources to target weights by systematic sampling, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.common import table

#: Words as the contract counts them.
WORD = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 3
ROWS_A_LANE = 200_000
MOST_LANES = 4096


def weight_cycle(rank: Column) -> Column:
    """Weights 1, 2, 3, repeating over the sources in order."""
    return ((rank - 1) % 3 + 1).cast("double")


def source_targets(totals: DataFrame, most_copies: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) to those columns and ``target``.

    Targets share the total of all sizes by weight; none exceeds ``most_copies`` times its source's size, and the excess
    goes to the others by weight. That is target = min(cap, level * weight) with one level, found in one pass over the
    sources in order of cap / weight: where the first k are full, level = (total - their caps) / (remaining weights).
    There is one row per source here, an aggregate; no document passes through these windows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = totals.withColumn("weight", weight_cycle(F.row_number().over(by_name))).withColumn("cap", F.col("source_size") * float(most_copies))
    by_fill = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    full_first = Window.orderBy(*by_fill).rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("weights", F.sum("weight").over(everything))
    w = w.withColumn(
        "level",
        (F.col("total") - F.coalesce(F.sum("cap").over(full_first), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(full_first), F.lit(0.0))),
    ).withColumn("place", F.row_number().over(Window.orderBy(*by_fill)))
    # the level of the first source that its share does not fill; the capped sources come before it
    unfilled = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))
    w = w.withColumn("level", F.min(unfilled).over(everything)["level"])
    return w.select("source", "source_size", F.least("cap", F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, size: Column, seed: str = "mix", most_copies: int = MOST_COPIES, rows_a_lane: int = ROWS_A_LANE) -> DataFrame:
    """``docs`` with size, source_size, target and ``copies`` (0 to ``most_copies``), one row per row of ``docs``.

    A document of a source is expected target / source_size times. Documents of a source are put in one order; the prefix
    sum of expectations plus one random offset of the source crosses ``copies`` integers at each document. The order goes by
    size classes first, so that every range of sizes is sampled evenly and the words taken come near the target.

    The prefix sum has two levels: a source's rows are dealt to strata (size class and a lane of the key's digest), rows are
    numbered inside a stratum, and the strata's counts are summed ahead of them. So a source with a third of all rows is the
    work of many tasks. Defined results: null text has size 0; null source is a source of its own, after the others; a null
    doc_id is ordered first; repeated rows are rows of their own; an empty table gives no rows. Columns whose names begin
    with ``_mix_`` are used on the way; the columns of the result named above replace any of ``docs`` with the same name.
    """
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    keyed = docs.withColumn("_mix_size", F.coalesce(size, F.lit(0)).cast("long"))
    digits = F.col("_mix_size").cast("string")
    keyed = keyed.withColumn("_mix_class", F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int"))
    n = docs.count()
    lanes = int(min(MOST_LANES, max(1, -(-n // rows_a_lane))))
    keyed = keyed.withColumn("_mix_lane", (_digest(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % lanes).cast("int"))
    stratum = ["source", "_mix_class", "_mix_lane"]

    strata = table(keyed.groupBy(*stratum).agg(F.count("*").alias("_mix_n"), F.sum("_mix_size").alias("_mix_words")))
    totals = strata.groupBy("source").agg(F.sum("_mix_words").alias("source_size"))
    ahead = Window.partitionBy("source").orderBy("_mix_class", "_mix_lane").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(totals, most_copies)
    plan = (
        strata.withColumn("_mix_ahead", F.coalesce(F.sum("_mix_n").over(ahead), F.lit(0)))
        .alias("s")
        .join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .select("s.source", "_mix_class", "_mix_lane", "_mix_ahead", "source_size", "target")
    )
    # rows of equal size and doc_id by all they hold, so that reruns agree
    told = F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c, kind in docs.dtypes if c in kept and "map<" not in kind])
    inside = Window.partitionBy(*stratum).orderBy(F.col("_mix_size"), F.col("doc_id"), told)
    numbered = keyed.drop("source_size", "target", "copies", "size").withColumn("_mix_row", F.row_number().over(inside))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in stratum]
    joined = numbered.alias("d").join(plan.alias("p"), same[0] & same[1] & same[2])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = _digest(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), F.col("d.source")), F.lit("")))) / F.lit(2.0**32)
    row = F.col("_mix_ahead") + F.col("_mix_row")
    copies = F.floor(start + rate * row) - F.floor(start + rate * (row - 1))
    return joined.select(
        *[F.col(f"d.`{c}`") for c in kept],
        F.col("_mix_size").alias("size"),
        "source_size",
        "target",
        F.least(copies, F.lit(most_copies)).cast("long").alias("copies"),
    )


def _digest(text: Column) -> Column:
    """32 bits of a text's MD5, as a long; SQL engines agree on it."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    from waybill.llm.common import read

    docs = read(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).alias("words"))
    mixed = mix(table(narrow), F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), k AS (
  SELECT *, length(size::VARCHAR) * 100 + substr(size::VARCHAR, 1, 2)::INT AS cls,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % greatest(1, least(4096, ceil(count(*) OVER () / 200000.0)::BIGINT)) AS lane
  FROM d
), t AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM t
), l AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT source, source_size, least(cap, coalesce(arg_min(level, place) FILTER (level * weight <= cap) OVER (), 0.0) * weight) AS target FROM l
), r AS (
  SELECT k.doc_id, k.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix:' || coalesce('=' || k.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start,
    row_number() OVER (PARTITION BY k.source ORDER BY cls, lane, size, doc_id NULLS FIRST) AS i
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  (least(3, floor(start + rate * i) - floor(start + rate * (i - 1))) * size)::BIGINT AS taken
FROM r
"""
