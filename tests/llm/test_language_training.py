"""What training a language model takes to the driver, and repeated rows and ties in predictions."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waybill.llm import langid


def made(seed, letters, n, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters + " ") for _ in range(1 + k * longest // n)) for k in range(n)]


def plain_spans(texts, chars):
    """Short texts whole, of each other one its share of what is left, from the place that its digest draws."""
    out = []
    for k, t in enumerate(sorted(texts, key=len)):
        share = min(len(t), (chars - sum(map(len, out))) // (len(texts) - k))
        at = zlib.crc32(t.encode()) % (len(t) - share + 1)
        out.append(t[at : at + share])
    return sorted(out)


def equal(a, b):
    same = all(np.array_equal(x.base, y.base) and np.array_equal(x.owner, y.owner) and np.array_equal(x.target, y.target) for x, y in zip(a.tables, b.tables, strict=True))
    return same and a.languages == b.languages and a.sizes == b.sizes and np.array_equal(a.ids, b.ids)


@pytest.mark.parametrize("parts", [1, 5])
def test_trained_as_on_whole_texts(spark, monkeypatch, parts):
    texts = {"x": made(1, "abcdé", 9, 30_000), "y": made(2, "cdef𝄞", 7, 900), "z": ["", "12"]}
    rows = [(k * 100 + i, lang, t) for k, (lang, own) in enumerate(texts.items()) for i, t in enumerate(own)]
    rows += [rows[3], (None, "x", None), (900, None, "abc" * 50_000)]  # a repeated row is drawn once
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(parts)
    seen = []
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda t, chars: seen.append(t) or fit(t, chars))
    got = langid.train(docs, F.lit(True), chars=2000)
    assert {k: sorted(v) for k, v in seen[0].items()} == {k: plain_spans(v, 2000) for k, v in texts.items()} and got.languages == ["x", "y"]
    assert got.sizes == fit(texts, 2000).sizes
    assert {k: sum(map(len, v)) for k, v in seen[0].items()} == {"x": 2000, "y": 2000, "z": 2}
    # languages share what all may hold
    few = langid.train(docs, F.lit(True), chars=2000, most_chars=900)
    assert {k: sum(map(len, v)) for k, v in seen[1].items()} == {"x": 300, "y": 300, "z": 2} and max(few.sizes) <= 309


def test_keys_with_several_texts(spark):
    docs = [(1, "x", "b" * 40), (1, "x", "ab" * 5), (None, "x", "cc dd"), (None, "x", "dc"), (2, "y", "q" * 9)]
    found = []
    for order in (docs, docs[::-1]):
        found.append(langid.train(spark.createDataFrame(order, "doc_id long, lang string, text string").repartition(3), F.lit(True)))
    assert equal(*found) and found[0].sizes == [13, 9]  # the shorter of one key: "ab" * 5, then a blank, then "dc"


def test_ties_and_repeated_rows(spark):
    model = langid.fit({"b": ["same words"] * 3, "a": ["same words"] * 3})
    d = spark.createDataFrame([(1, "same words"), (1, "same words"), (2, "words same")], "doc_id long, text string").repartition(2)
    got = langid.identify(d, model).collect()
    assert len(got) == 3 and {(r.lang_pred, r.score) for r in got} == {("a", 0.5)}
