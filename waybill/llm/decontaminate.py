"""Benchmark decontamination by winnowing, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.common import ascii_lower, read, table

#: Words as the contract counts them: runs of letters, digits and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text whose A-Z are not lower-cased yet.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
GRAM = 5
#: Distinct benchmark windows up to which they are broadcast (about 150 bytes each); beyond it both sides are shuffled.
MOST_BROADCAST = 200_000
#: Documents with hits up to which their results (about 120 bytes each) are broadcast to the documents.
MOST_FOUND = 200_000
_POSITION_BITS = 30


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """``body`` of the value, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _picks(words: Column, length: int, gram: int) -> Column:
    """For each window of ``length`` words, the packed least gram: 33 bits of its hash above 30 bits of its place.

    The place decides ties, leftmost first, alike in documents and items. 2**30 places suffice for any string Spark can hold.
    """
    n = F.size(words)
    packed = F.transform(
        F.sequence(F.lit(0), n - gram),
        lambda i: F.shiftleft(F.xxhash64(F.slice(words, i + 1, gram)).bitwiseAND(F.lit((1 << 33) - 1)), _POSITION_BITS).bitwiseOR(i.cast("long")),
    )
    if length == gram:
        return packed
    return let(packed, lambda p: F.transform(F.sequence(F.lit(1), n - length + 1), lambda s: F.array_min(F.slice(p, s, length - gram + 1))))


def _gram(length: int, gram: int) -> int:
    return min(gram, length)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (length, hash, lag, window, wid) of all items, and (wid, item_id).

    ``lag`` is where in the window its least gram begins. An item of fewer words than a window is one window itself.
    """
    items = table(benchmark.select("item_id", _words("text").alias("w")).where(F.size("w") > 0))
    lengths = [r[0] for r in items.select(F.least(F.size("w"), F.lit(window)).alias("n")).distinct().collect()]
    parts = []
    for n in sorted(lengths):
        fits = F.least(F.size("w"), F.lit(window)) == n
        # guarded once more: a filter on the exploded array may be put before this one
        own = items.where(fits).withColumn("pick", F.when(fits, _picks(F.col("w"), n, _gram(n, gram))))
        parts.append(
            own.select("item_id", "w", F.posexplode("pick").alias("s", "pick")).select(
                "item_id",
                F.lit(n).alias("length"),
                F.shiftright("pick", _POSITION_BITS).alias("hash"),
                (F.col("pick").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)) - F.col("s")).cast("int").alias("lag"),
                F.slice("w", F.col("s") + 1, n).alias("window"),
            )
        )
    if not parts:
        spark = benchmark.sparkSession
        return (
            spark.createDataFrame([], "length int, hash long, lag int, window array<string>, wid string"),
            spark.createDataFrame([], "wid string, item_id string"),
        )
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = table(rows.withColumn("wid", F.md5(F.array_join("window", " ").cast("binary"))))
    windows = table(rows.select("length", "hash", "lag", "window", "wid").distinct())
    return windows, rows.select("wid", "item_id").distinct()


def hits(docs: DataFrame, windows: DataFrame, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, start, length, wid): every place in a document where a benchmark window occurs.

    Each document keeps the winnowed grams of its windows, each with the words that any window around it could take. Grams
    meet the benchmark's by hash, and each meeting is extended to the whole window and compared word for word. A window that
    occurs picks the same gram in both texts, so none is missed.
    """
    n_windows = windows.count()
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())
    side = F.broadcast(windows) if n_windows <= MOST_BROADCAST else windows
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    place = lambda p: p.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).cast("int")
    out = None
    for n in lengths:
        g = _gram(n, gram)

        def around(w: Column) -> Column:  # called before the loop goes on
            """Each kept gram with its place and the words from ``from`` on that windows with it can take."""
            pick = lambda p: F.struct(  # noqa: B023, E731
                F.shiftright(p, _POSITION_BITS).alias("hash"),
                place(p).alias("place"),
                F.greatest(place(p) - (n - g), F.lit(0)).alias("from"),
                F.slice(w, F.greatest(place(p) - (n - g), F.lit(0)) + 1, 2 * n - g).alias("near"),
            )
            return F.when(F.size(w) >= n, F.transform(F.array_distinct(_picks(w, n, g)), pick))

        grams = keyed.select("doc_id", "text_hash", F.inline(let(_words("text"), around)))
        met = grams.join(side.where(F.col("length") == n), "hash")
        start = F.col("place") - F.col("lag")
        fits = (start >= F.col("from")) & (F.slice("near", F.greatest(start - F.col("from"), F.lit(0)) + 1, n) == F.col("window"))
        found = met.where(fits).select("doc_id", "text_hash", start.alias("start"), "length", "wid")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, start int, length int, wid string")
    return out.distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, n_hit, n_items, items_sha256) of each document in which a benchmark window occurs.

    A row stands for all rows with this doc_id and text. A word inside any occurring window is hit, once.
    """
    windows, owners = benchmark_windows(benchmark, window, gram)
    found = table(hits(docs, windows, gram))
    key = ["doc_id", "text_hash"]
    spans = found.groupBy(*key, "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    before = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    covered = spans.withColumn("new", F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0)))
    n_hit = covered.groupBy(*key).agg(F.sum("new").cast("long").alias("n_hit"))
    items = found.select(*key, "wid").distinct().join(owners, "wid").select(*key, F.col("item_id").cast("string").alias("item")).distinct()
    named = items.groupBy(*key).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))
    return (
        n_hit.alias("a").join(named.alias("b"), same).select("a.doc_id", "a.text_hash", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: its columns, and n_words, n_hit, n_items, items_sha256, contaminated.

    Contaminated: at least one word in twenty is hit. Defined results: null or wordless texts have no words and no hits; null
    doc_ids are kept; repeated rows each get their result; an empty benchmark hits nothing; columns of ``docs`` named like a
    result are replaced. The digest of no items is that of the empty text.
    """
    result = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    own = [c for c in docs.columns if c not in result and c != "_text_hash"]
    found = table(contamination(docs.select("doc_id", "text"), benchmark, window, gram))
    if found.count() <= MOST_FOUND:
        found = F.broadcast(found)
    d = docs.select(*own).withColumn("_text_hash", F.xxhash64("text")).withColumn("n_words", F.coalesce(F.regexp_count("text", F.lit(RAW_WORD)), F.lit(0)).cast("long"))
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d._text_hash") == F.col("f.text_hash"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return d.alias("d").join(found.alias("f"), same, "left").select(
        *[F.col(f"d.`{c}`") for c in own],
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    benchmark = read(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate(docs, benchmark).drop("text")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, s, n, win FROM dw WHERE (n, win) IN (SELECT (n, win) FROM win)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit JOIN win USING (n, win)) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
