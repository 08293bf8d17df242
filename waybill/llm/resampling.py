"""Importance resampling towards a target corpus: bucketed n-gram weights, noise by key, and ranks from a histogram of scores."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.llm.common import APART, Words, read, table, text_slices

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
#: Ranges of scores whose counts are summed first: so many rows in one task, whatever the input.
RANGES = 4_096

# ---------------------------------------------------------------- crc32 of word sequences

_POLY = 0xEDB88320
#: Word lengths whose shifts are tabled: a table is 4 KB.
_TABLED = 64


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLY), t >> 1)
    return t


_TABLE = _byte_table()
_BYTE = np.uint32(255)


def _shifted(crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """``tables`` (n, 4, 256) or (4, 256): what each of a crc's four bytes becomes when bytes follow."""
    at = (np.arange(len(crc)),) if tables.ndim == 3 else ()
    out = np.zeros(len(crc), np.uint32)
    for k in range(4):
        out ^= tables[(*at, k, (crc >> np.uint32(8 * k)) & _BYTE)]
    return out


def _shift_tables() -> np.ndarray:
    """(length, 4, 256): a crc's bytes after so many zero bytes; linear, so any crc is the sum (xor) of its bytes'."""
    out = np.zeros((_TABLED, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, _TABLED):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ _TABLE[out[n - 1] & _BYTE]
    return out


_SHIFTS = _shift_tables()


def followed(crc: np.ndarray, crc_next: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of texts made of two parts, from the parts' crc32 and the second's length in bytes."""
    out = np.zeros(len(crc), np.uint32)
    near = length < _TABLED
    own, n = crc[near], length[near]
    part = np.zeros(len(own), np.uint32)
    for k in range(4):
        part ^= _SHIFTS[n, k, (own >> np.uint32(8 * k)) & _BYTE]
    out[near] = part
    for i in np.flatnonzero(~near):  # words of so many bytes are rare
        left, value = int(length[i]), crc[i : i + 1]
        value = _shifted(value, _SHIFTS[left % (_TABLED - 1)])
        tables = _SHIFTS[_TABLED - 1]
        for _ in range(left // (_TABLED - 1)):
            value = _shifted(value, tables)
        out[i] = value[0]
    return out ^ crc_next


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of the byte ranges, a byte a step over all words at once; long words one by one."""
    n = ends - starts
    crc = np.full(len(n), 0xFFFFFFFF, np.uint32)
    live, k = np.arange(len(n)), 0
    while len(live):
        crc[live] = (crc[live] >> np.uint32(8)) ^ _TABLE[(crc[live] ^ data[starts[live] + k]) & _BYTE]
        k += 1
        live = live[n[live] > k]
        if k == _TABLED:
            for i in live:
                crc[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes()) ^ 0xFFFFFFFF
            break
    return ~crc


def features(words: Words, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, crc32) of every run of 1 to ``longest`` consecutive words of a text, joined by one blank; a pair for each length."""
    owner = np.repeat(np.arange(len(words.counts)), words.counts)
    crc, size = word_crcs(words.data, words.starts, words.ends), words.ends - words.starts
    blank = np.full(len(crc), zlib.crc32(b" "), np.uint32)
    after = followed(blank, crc, size)  # a blank and the word
    run = crc
    yield owner, run
    for k in range(1, longest):
        run = followed(run[: len(crc) - k], after[k:], size[k:] + 1)
        inside = owner[: len(crc) - k] == owner[k:]
        yield owner[: len(crc) - k][inside], run[inside]


# ---------------------------------------------------------------- counts, weights, ranks


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket. A task hands on one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0), most=1 << 20):
                for _, crc in features(Words(data, offsets, APART)):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array(total[full])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """What a feature of each bucket adds to a weight: thousandths of the log ratio of its smoothed shares in target and docs.

    A row a bucket comes to the driver, and an array of ``buckets`` numbers is broadcast, however many documents there are.
    """
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, out in ((bucket_counts(docs, buckets), s), (bucket_counts(target, buckets), t)):
        for r in counts.collect():
            out[r.bucket] = r.n
    ratio = ((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def with_weight(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``docs`` with n_words, n_features and weight of each whole text; own columns of these names are replaced.

    Null and empty texts have no features and weight 0; repeated rows each get theirs; an empty table gives no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(gain)
    new = ["n_words", "n_features", "weight"]
    kept = [c for c in docs.columns if c not in new]
    own = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = known.value
        for batch in batches:
            made = np.zeros((3, batch.num_rows), np.int64)
            for row, n, data, offsets in text_slices(batch.column(at), most=1 << 20):
                words = Words(data, offsets, APART)
                made[0, row : row + n] = words.counts
                for owner, crc in features(words):
                    made[1, row : row + n] += np.bincount(owner, minlength=n)
                    made[2, row : row + n] += np.bincount(owner, gain[crc % np.uint32(len(gain))], minlength=n).astype(np.int64)
            yield pa.record_batch([*batch.columns, *[pa.array(x) for x in made]], names=[*kept, *new])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, *[T.StructField(c, T.LongType()) for c in new]]))


def with_score(weighted: DataFrame, seed: int = 42) -> DataFrame:
    """``weighted`` with score: the weight plus thousandths of a Gumbel number drawn from the key's digest. A null key draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return weighted.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))))


def drawn(scored: DataFrame, eligible, percent: int = PERCENT) -> DataFrame:
    """``scored`` (doc_id, score and others) with ``rank``: 1, 2, 3... for the best ``percent`` of the rows where ``eligible`` holds, else null.

    Ranks come from a histogram of the scores, which are whole numbers: counts of each score, summed from the highest down,
    are the ranks before it. The sum has two levels, ranges of scores and the scores of a range, so no task sees more
    than RANGES rows or the scores of one range. The cutoff is the score at which the draw is full; only rows from it up are
    numbered, by doc_id within their score (null first; rows of one doc_id by all they hold). ``scored`` is read several
    times: pass a table. Repeated rows are rows of their own; an empty table gives no rows; an own column ``rank`` is replaced.
    """
    own = scored.drop("rank")
    counts = table(own.where(eligible).groupBy("score").agg(F.count("*").alias("_n")))
    whole = counts.agg(F.sum("_n").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    draw = (whole.n or 0) * percent // 100
    if not draw:
        return own.withColumn("rank", F.lit(None).cast("long"))
    width = (whole.high - whole.low) // RANGES + 1
    counts = counts.withColumn("_range", F.floor((F.col("score") - whole.low) / F.lit(width)))
    above = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("_range").agg(F.sum("_n").alias("_of_range")).withColumn("_above", F.coalesce(F.sum("_of_range").over(above), F.lit(0)))
    ranges = F.broadcast(ranges.where(F.col("_above") < draw).select("_range", "_above"))  # RANGES rows at most
    inside = Window.partitionBy("_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(ranges, "_range").withColumn("_before", F.col("_above") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    offsets = table(offsets.where(F.col("_before") < draw).select("score", "_before"))
    cutoff = offsets.agg(F.min("score")).first()[0]
    surviving = F.coalesce(eligible & (F.col("score") >= cutoff), F.lit(False))
    told = F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c, kind in own.dtypes if "map<" not in kind])
    place = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", told))
    ranked = own.where(surviving).join(offsets, "score").withColumn("rank", F.col("_before") + place)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")).cast("long"))
    names = [*own.columns, "rank"]
    return ranked.select(*names).unionByName(own.where(~surviving).withColumn("rank", F.lit(None).cast("long")).select(*names))


def op12_resample(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    gain = gains(docs, read(spark, sf_dir, "benchmark"))
    scored = table(with_score(with_weight(docs, gain).drop("text")))
    return drawn(scored, F.col("n_words") >= LEAST_WORDS).select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH ct AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)::BIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), raw AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'b', item_id, row_number() OVER (), coalesce(text, '') FROM benchmark
), w AS (
  SELECT side, id, r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM raw
), f AS (
  SELECT side, r, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS f FROM w, (SELECT unnest([1, 2, 3]) AS k)
), g AS (
  SELECT side, r, f, count(*) AS n FROM f GROUP BY ALL
), b AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(hex(f)) // 2 + 1), lambda i: ('0x' || hex(f)[2 * i - 1:2 * i])::BIGINT)), lambda c, x: xor(c >> 8, ct.t[xor(c, x) % 256 + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM g), ct
), gb AS (
  SELECT side, r, bucket, sum(n)::BIGINT AS n FROM g JOIN b USING (f) GROUP BY ALL
), c AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM gb GROUP BY 1
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM c) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM c) + 10000))))::BIGINT AS gain FROM c
), d AS (
  SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM gb JOIN gain USING (bucket) WHERE side = 'd' GROUP BY 1
), s AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN d USING (r) WHERE side = 'd'
), k AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE n_words >= 20
)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN rank <= (SELECT count(*) * 5 // 100 FROM s WHERE n_words >= 20) THEN rank END AS rank
FROM s LEFT JOIN k ON s.doc_id = k.doc_id
"""
