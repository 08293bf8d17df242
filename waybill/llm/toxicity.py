"""Toxicity by weak supervision: many voters, a label model, and a linear classifier trained on its posteriors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.llm.common import APART, Words, crc_mod, hash_words, logistic, mix, read, sample_labelled, text_slices

#: Labelled documents of each class that the voters' lexicons and the classifier are fitted on, at most.
PER_CLASS = 4_000
#: Terms of the mined lexicons, at most.
TERMS = 1_024
#: Lexicon voters that the mined terms are dealt to, at most.
VOTERS = 24
#: Labelled texts of each class on the split that sets the scale, below which all set it.
LEAST_SCALED = 8
#: General English insults: one voter a line.
LEXICONS = (
    "idiot moron imbecile fool stupid dumb brainless cretin",
    "loser pathetic worthless useless failure nobody",
    "scum trash garbage filth vermin disgusting vile",
    "clown joke liar coward freak creep jerk",
)
#: Leading bytes of words that are terms beside whole words: inflected forms share them.
STEMS = (4, 5, 6, 7)
#: Bytes of texts that are looked through at once; a longer text is looked through whole.
SLICE = 1 << 20


def _terms(words: Words) -> list[np.ndarray]:
    """Hashes of each word, and of its leading bytes where it is longer."""
    out = [words.hashes()]
    for k in STEMS:
        h = hash_words(words.data, words.starts, np.minimum(words.ends, words.starts + k))
        out.append(mix(h + np.uint64(k)))
    return out


def _lexicon_terms(line: str) -> np.ndarray:
    column = pa.array([line])
    return np.concatenate([Words(data, offsets, APART).hashes() for _, _, data, offsets in text_slices(column)])


def _present(column: pa.Array, terms: np.ndarray) -> np.ndarray:
    """For each text, which of the sorted ``terms`` it holds; and in a last column the share of words with ``!``."""
    parts = []
    for _, n, data, offsets in text_slices(column, most=SLICE):
        words = Words(data, offsets, APART)
        owner = np.repeat(np.arange(n), words.counts)
        x = np.zeros((n, len(terms) + 1), np.float32)
        for h in _terms(words):
            if len(terms) and len(h):
                at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                hit = terms[at] == h
                x[owner[hit], at[hit]] = 1
        marks = np.concatenate(([0], np.cumsum(data[: offsets[-1]] == 33)))
        x[:, -1] = np.minimum(1, (marks[offsets[1:]] - marks[offsets[:-1]]) / np.maximum(1, words.counts))
        parts.append(x)
    return np.concatenate(parts) if parts else np.zeros((0, len(terms) + 1), np.float32)


def mine_terms(texts: list[str], y: np.ndarray, most: int = TERMS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of terms that go with label 1, chosen by the likelihood ratio of their document counts, and their log odds."""
    token, ones, zeros = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for row, n, data, offsets in text_slices(pa.array(texts, pa.large_string())):
        words = Words(data, offsets, APART)
        doc = np.repeat(np.arange(row, row + n), words.counts)
        for h in _terms(words):
            order = np.lexsort((doc, h))
            h, own = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
            h, label = h[new], y[own[new]]
            # counts so far and those of this slice, which holds whole documents
            token, inverse = np.unique(np.concatenate((token, h)), return_inverse=True)
            ones = np.bincount(inverse, np.concatenate((ones, label)), len(token))
            zeros = np.bincount(inverse, np.concatenate((zeros, 1 - label)), len(token))
    if not len(token):
        return np.zeros(0, np.uint64), np.zeros(0)
    n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    n = ones + zeros
    expect1, expect0 = n * n1 / (n1 + n0), n * n0 / (n1 + n0)
    ratio = 2 * (ones * np.log(np.maximum(ones, 0.5) / expect1) + zeros * np.log(np.maximum(zeros, 0.5) / expect0))
    good = (ratio > 18) & (ones / n1 > 16 * (zeros + 0.5) / n0)
    best = np.flatnonzero(good)[np.argsort(-ratio[good], kind="stable")[:most]]
    order = best[np.argsort(token[best])]
    return token[order], np.log((ones[order] + 0.5) / n1) - np.log((zeros[order] + 0.5) / n0)


def lone(texts: list[str]) -> np.ndarray:
    """Places of texts without the near copies of an earlier one: those with the same least shingle of three words."""
    least = np.zeros(len(texts), np.uint64)
    for row, n, data, offsets in text_slices(pa.array(texts, pa.large_string())):
        words = Words(data, offsets, APART)
        h = words.hashes()
        h = np.concatenate((h, np.zeros(2, np.uint64)))
        shingles = mix(h[:-2] * np.uint64(3) + mix(h[1:-1]) * np.uint64(5) + mix(mix(h[2:])))
        for i in range(n):
            own = shingles[words.first[i] : words.first[i + 1]]
            least[row + i] = own.min() if len(own) else 0
    return np.sort(np.unique(least, return_index=True)[1])


def label_model(votes: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 from voters' votes (1, -1, 0: abstains) alone: no label is seen.

    Returns the posteriors, the voters' rates (label, voter, vote 1, -1 or 0: what each says under either label) and their
    correlations beyond the label. Expectation maximisation of a generative model: a row has a label, each voter votes by
    its own rates under it. It starts from the votes' sums, so voters are taken to be right more often than not. Voters that
    agree beyond what the label explains are correlated, found from their residuals: their evidence is divided by the
    effective size of their group, so that terms that come together don't count many times.
    """
    n, m = votes.shape
    kinds = [(votes == v).astype(float) for v in (1, -1, 0)]
    post = 1 / (1 + np.exp(-np.clip(votes.sum(1), -4, 4)))
    share, tied, rates = np.ones(m), np.eye(m), np.zeros((2, m, 3))
    for k in range(rounds):
        on, off = post.sum(), n - post.sum()
        prior = np.clip(on / max(1, n), 0.005, 0.995)
        gain = np.zeros((n, m))
        for i, kind in enumerate(kinds):
            rates[1, :, i], rates[0, :, i] = (post @ kind + 0.1) / (on + 0.3), ((1 - post) @ kind + 0.1) / (off + 0.3)
            gain += kind * np.log(rates[1, :, i] / rates[0, :, i])
        if k % 10 == 9:
            rest = votes - np.outer(post, post @ votes / max(on, 1e-9)) - np.outer(1 - post, (1 - post) @ votes / max(off, 1e-9))
            spread = np.sqrt((rest**2).mean(0)) + 1e-6
            tied = (rest.T @ rest) / n / spread[:, None] / spread
            np.fill_diagonal(tied, 1.0)
            share = 1 / np.maximum(1, (np.clip(tied, 0, 1) ** 2).sum(1))
        logit = np.log(prior / (1 - prior)) + gain @ share
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        settled = np.abs(new - post).max() < 1e-6
        post = new
        if settled and k > 20:
            break
    return post, rates, tied


@dataclass
class Model:
    terms: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        z = _present(column, self.terms) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def voters(x: np.ndarray, terms: np.ndarray, mined: np.ndarray, odds: np.ndarray, general: list[np.ndarray]) -> np.ndarray:
    """Votes of the lexicon and pattern voters on texts with the terms ``x``.

    Mined terms are dealt to voters in turn by their odds; a voter says 1 for a text with one of its terms and else abstains,
    as do the general lexicons. Patterns: a text with none of the terms is clean, one with very many exclamation marks
    without insults too.
    """
    deal = np.full(len(terms), -1)
    deal[np.searchsorted(terms, mined)] = np.argsort(np.argsort(-odds, kind="stable")) % VOTERS
    columns = [np.sign(x[:, :-1][:, deal == v].sum(1)) for v in range(min(VOTERS, len(mined)))]
    columns += [np.sign(x[:, :-1][:, np.isin(terms, g)].sum(1)) for g in general]
    hits = x[:, :-1].sum(1)
    columns += [-(hits == 0).astype(float), np.where(hits >= 3, 1.0, 0.0), np.where((x[:, -1] > 0.3) & (hits < 2), -1.0, 0.0)]
    return np.stack(columns, 1)


def fit(texts: list[str], y: np.ndarray) -> Model:
    """A model from labelled texts. Without any, the general lexicons alone vote.

    The labels choose the mined lexicons on four fifths of the texts and set the scores' scale on the last fifth. Between
    them, the label model sees votes only, and the classifier is trained on what it makes of them.
    """
    general = [_lexicon_terms(line) for line in LEXICONS]
    apart = lone(texts)
    texts, y = [texts[i] for i in apart], y[apart]
    place = np.zeros(len(y), int)
    for label in (0, 1):
        place[y == label] = np.arange(int((y == label).sum()))
    scale_on = place % 5 == 4
    mined, odds = mine_terms([t for t, out in zip(texts, scale_on) if not out], y[~scale_on])
    terms = np.unique(np.concatenate([mined, *general]))
    if not len(y):
        return Model(terms, np.append(np.full(len(terms), 5.0), 0.0), -3.0)
    x = _present(pa.array(texts, pa.large_string()), terms)
    post, _, _ = label_model(voters(x, terms, mined, odds, general))
    w, b = logistic(x, post, ridge=1e-3)
    # the scale and place of the scores are set on labels, so that they read as chances; far scores say no more there
    if min((y[scale_on] == label).sum() for label in (0, 1)) < LEAST_SCALED:
        scale_on[:] = True  # too few for a split
    z, y = (x @ w + b)[scale_on], y[scale_on]
    middle = np.median(np.concatenate((z[y == 1], [0.0])))
    scale, shift = logistic(np.minimum(z, middle)[:, None], y, ridge=1e-6)
    scale = max(float(scale[0]), 0.1)
    return Model(terms, w * scale, float(b * scale + shift))


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and a score from 0 to 1, higher for likelier toxic, one row per row.

    The score sees whole texts and nothing else. Null and empty texts get the score of a text without terms; repeated rows
    each get theirs; a column of the score's name is replaced; an empty table gives no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != name]
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(known.value.score(batch.column(at)), pa.float64())
            yield pa.record_batch([*batch.columns, found], names=[*kept, name])

    own = docs.select(*kept)
    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField(name, T.DoubleType())]))


def train(docs: DataFrame, labels: DataFrame, use: Column, per_class: int = PER_CLASS) -> Model:
    """A model fitted on at most ``per_class`` labelled documents of each class, and MOST_BYTES of text, among rows where ``use`` holds."""
    return fit(*sample_labelled(docs, labels, "toxic", use, per_class))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    return with_score(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
