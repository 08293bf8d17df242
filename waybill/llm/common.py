"""Helpers that the corpus operators share: tables on shared storage, word hashing over Arrow batches, connected components."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- tables


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. On one machine (master local[...]) a temporary one stands in where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(shared_folder, "own", None)
        if not found:
            found = shared_folder.own = tempfile.mkdtemp(prefix="waybill-")
    return found.rstrip("/")


def table(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends there, so a lost executor costs one read."""
    path = f"{shared_folder(df.sparkSession)}/waybill/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone: the fast built-in where a text is ASCII only."""
    az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, az, az.lower()))


# ---------------------------------------------------------------- words of Arrow batches

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, bytes of other characters as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_29, _32 = np.uint64(29), np.uint64(32)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _32)) * _A
    h = (h ^ (h >> _29)) * _B
    return h ^ (h >> _32)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges; ``data`` has 8 spare bytes at its end. Eight bytes a step, over all words at once."""
    n = ends - starts
    view = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = n.astype(np.uint64) * _C
    live, at = slice(None), starts
    k = 0
    left = n
    while len(at):
        h[live] = mix((h[live] + _B) ^ (view[at] & _MASK[np.minimum(left, 8)]))
        k += 8
        live = np.flatnonzero(n > k)
        if k >= 1024:  # words of a thousand bytes are rare: one digest of the rest
            for i in live:
                rest = hashlib.blake2b(data[starts[i] + k : ends[i]].tobytes(), digest_size=8).digest()
                h[i] ^= np.uint64(int.from_bytes(rest, "little"))
            break
        at, left = starts[live] + k, n[live] - k
    return h


class Words:
    """Words of some texts: ``starts`` and ``ends`` in ``data`` and the text that each belongs to; ``first[i]:first[i+1]`` are text i's."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE):
        n = int(offsets[-1])
        inside = ~white[data[:n]]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], inside))[:n]
        after = np.concatenate((inside[1:], [False]))[:n]
        self.data = data
        self.starts = np.flatnonzero(inside & (~before | edge[:n]))
        self.ends = np.flatnonzero(inside & (~after | edge[1 : n + 1])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return hash_words(self.data, self.starts, self.ends)


def text_slices(column: pa.Array, lower: bool = True, most: int = 4 << 20):
    """Runs of a string column of about ``most`` bytes: (first row, rows, bytes with 8 spare, offsets). Nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        stop = min(stop, len(column))
        own = raw[offsets[row] : offsets[stop]]
        data = np.concatenate((LOWER[own] if lower else own, np.zeros(8, np.uint8)))
        yield row, stop - row, data, offsets[row : stop + 1] - offsets[row]
        row = stop


# ---------------------------------------------------------------- components


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: of any orderable type); the component is its smallest node.

    Large-star and small-star by turns (Kiveris and others, 2014): each round joins neighbours to the smallest one seen, so
    rounds grow with the logarithm of a component's size. Neighbour minima are aggregated before the shuffle and joined
    back, never gathered, so that a node with very many links is no single task's work. Rounds are cut by written tables.
    """
    edges = table(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    for _ in range(most_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.inline(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
            .where("u <> v")
            .distinct()
        )
        edges = table(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()


# ---------------------------------------------------------------- fitting on bounded samples

#: Bytes that end a word of letters and digits.
APART = np.ones(256, bool)
APART[128:] = False
APART[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


#: Bytes of text that a sample brings to the driver, at most; half for each class.
MOST_BYTES = 16 << 20
#: Texts that take more than this part of their class's bytes come last.
MOST_SHARE = 16


def sample_labelled(docs: DataFrame, labels: DataFrame, target: str, use: Column, per_class: int, most_bytes: int = MOST_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of at most ``per_class`` documents of each class, those whose key's digest is smallest.

    Only rows of ``labels`` where ``use`` holds take part. The keys, at most 2 * per_class, are broadcast, first for the
    texts' sizes; whole texts are then chosen in the order of the digests while they fit in half of ``most_bytes`` for each
    class, and fetched. A text that does not fit is passed over and the next ones go on; texts that take more than a
    MOST_SHARE-th of their class's bytes come after all others, the smallest first. Of repeated keys, one label and the
    smallest text count.
    """
    ranked = labels.where(use & F.col("doc_id").isNotNull()).select("doc_id", F.col(target).alias("label"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("at"))
    ids: dict[int, tuple[int, str]] = {}
    for label in (0, 1):
        for r in ranked.where(F.col("label") == label).orderBy("at", "doc_id").limit(per_class).collect():
            ids.setdefault(r.doc_id, (label, r.at))
    if not ids:
        return [], np.zeros(0)
    spark = docs.sparkSession
    known = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.xxhash64("text").alias("told"), "text")
    keys = spark.createDataFrame([(k,) for k in ids], "doc_id long")
    sizes = known.drop("text").join(F.broadcast(keys), "doc_id").groupBy("doc_id").agg(F.min(F.struct("size", "told")).alias("m")).select("doc_id", "m.*").collect()
    chosen = []
    for label in (0, 1):
        own = sorted((r for r in sizes if ids[r.doc_id][0] == label), key=lambda r: (ids[r.doc_id][1], r.doc_id))
        long_ = most_bytes // (2 * MOST_SHARE)
        left = most_bytes // 2
        for r in sorted(own, key=lambda r: r.size if r.size > long_ else 0):
            if r.size <= left:
                left -= r.size
                chosen.append((r.doc_id, r.size, r.told, label))
    if not chosen:
        return [], np.zeros(0)
    wanted = F.broadcast(spark.createDataFrame(chosen, "doc_id long, size int, told long, label int"))
    rows = known.join(wanted, ["doc_id", "size", "told"]).groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy("doc_id").toArrow()
    return [t or "" for t in rows.column("text").to_pylist()], rows.column("label").to_numpy().astype(float)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 25, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on soft labels, by damped Newton steps."""
    n, d = x.shape
    weight = np.ones(n) if weight is None else weight
    total = max(float(weight.sum()), 1e-9)
    penalty = np.append(np.full(d, ridge), 1e-9)
    w = np.zeros(d + 1)
    for _ in range(rounds):
        slope, bend = penalty * w, np.zeros((d + 1, d + 1))
        for a in range(0, n, 1024):  # a block at a time: no copy of all rows
            own = slice(a, a + 1024)
            wide = np.column_stack((x[own], np.ones(len(x[own]))))
            p = 1 / (1 + np.exp(-np.clip(wide @ w, -30, 30)))
            slope += wide.T @ (weight[own] * (p - y[own])) / total
            bend += (wide * (weight[own] * np.maximum(p * (1 - p), 1e-5))[:, None]).T @ wide / total
        step = np.linalg.solve(bend + np.diag(penalty + 1e-9), slope)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w[:d], float(w[d])
