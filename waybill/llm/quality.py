"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.llm.common import LOWER, Words, crc_mod, hash_words, read, sample_labelled, text_slices

#: Labelled documents of each class that vote, at most: 4 * RANK bytes each are broadcast.
PER_CLASS = 1_500
RANK = 48
NEIGHBOURS = 25
#: Buckets of word terms; the terms of a word's form come after them.
BUCKETS = 1 << 11
_LAST, _CASE, _AGAIN, _LENGTH, _PAIR = 256, 4, 2, 16, 64
TERMS = BUCKETS + _LAST + _CASE + _AGAIN + _LENGTH + _PAIR
#: Score of texts that no voter is like, however many voters of each class are drawn.
UNDIRECTED = 0.5
#: Documents of a block of cosine products.
BLOCK = 512


def term_counts(column: pa.Array) -> Iterator[np.ndarray]:
    """Blocks of rows of square-rooted shares of terms: hashed words, last bytes, case, repetition of the word before, length.

    Words are runs without white space. The texts are taken whole; a text without words has a row of zeros.
    """
    for _, n, data, offsets in text_slices(column, lower=False, most=2 << 20):
        words = Words(data, offsets)
        owner = np.repeat(np.arange(n), words.counts)
        h = hash_words(LOWER[data], words.starts, words.ends)
        first, last, length = data[words.starts], data[words.ends - 1], words.ends - words.starts
        upper = lambda b: (b >= 65) & (b <= 90)
        second = data[np.minimum(words.starts + 1, words.ends - 1)]
        case = upper(first).astype(int) + 2 * (upper(second) & (length > 1))
        again = np.zeros(len(h), int)
        again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        before = data[np.maximum(words.ends - 2, words.starts)]
        twin = np.where((before == last) & (length > 1) & (last < 64), last, 0)
        columns, start = [(h >> np.uint64(40)).astype(np.int64) % BUCKETS], BUCKETS
        for values, size in ((last, _LAST), (case, _CASE), (again, _AGAIN), (np.minimum(length, _LENGTH - 1), _LENGTH), (twin, _PAIR)):
            columns.append(values.astype(np.int64) + start)
            start += size
        for a in range(0, n, BLOCK):
            b = min(n, a + BLOCK)
            lo, hi = words.first[a], words.first[b]
            out = np.zeros((b - a) * TERMS)
            row = (owner[lo:hi] - a) * TERMS
            for c in columns:
                out += np.bincount(row + c[lo:hi], minlength=len(out))
            yield np.sqrt(out.reshape(b - a, TERMS) / np.maximum(1, words.counts[a:b])[:, None]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_unit(counts * self.idf) @ self.axes)

    def score(self, column: pa.Array) -> np.ndarray:
        parts = [np.zeros(0)]
        for counts in term_counts(column):
            if not len(self.labels):
                parts.append(np.full(len(counts), UNDIRECTED))
                continue
            near = self.latent(counts) @ self.vectors.T
            k = min(self.neighbours, near.shape[1])
            last = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
            weight = np.maximum(near, 0.0) ** 2
            weight = np.where(near >= last, weight**4, 0)  # all that tie with the last one vote
            total = weight.sum(1)
            parts.append(np.where(total > 0, (weight @ self.labels) / np.maximum(total, 1e-30), UNDIRECTED))
        return np.clip(np.concatenate(parts), 0.0, 1.0)


def fit(texts: list[str], y: np.ndarray, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Model:
    """Latent-semantic axes of the labelled texts (the singular vectors of their weighted terms), and the texts on them."""
    if not len(y):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), neighbours)
    counts = np.concatenate(list(term_counts(pa.array(texts, pa.large_string()))))
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 0.1).astype(np.float32)
    x = _unit(counts * idf)
    # axes from the products of terms with each other: TERMS on a side, however many texts there are
    _, vectors = np.linalg.eigh(x.T.astype(np.float64) @ x)
    axes = vectors[:, ::-1][:, : min(rank, x.shape[1])].astype(np.float32)
    return Model(idf, axes, _unit(x @ axes), y, neighbours)


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and a score from 0 to 1, higher for likelier good, one row per row.

    Each whole text is compared with every voter, a block of texts at a time. All voters that tie with the last neighbour
    vote. Null and empty texts, and others that no voter is like, have no direction: their score is UNDIRECTED,
    as without voters. Repeated rows each get theirs; a column of the score's name is replaced; an
    empty table gives no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != name]
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array(known.value.score(batch.column(at)), pa.float64())], names=[*kept, name])

    own = docs.select(*kept)
    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField(name, T.DoubleType())]))


def train(docs: DataFrame, labels: DataFrame, use: Column, per_class: int = PER_CLASS) -> Model:
    """A model of at most ``per_class`` voters of each class among rows of ``labels`` where ``use`` holds."""
    return fit(*sample_labelled(docs, labels, "quality", use, per_class))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 4) != 2)
    return with_score(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
