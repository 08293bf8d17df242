"""Bounded samples behind long texts, one row of repeated ones whatever their order, and licences that no template sentence spells out."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waybill.llm import common, licenses, ngram_join, quality, toxicity


def test_long_texts_are_passed_over(spark):
    docs = spark.createDataFrame([(i, "x" * 10_000_000 if i in (3, 24) else f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 20)) for i in range(40)], "doc_id long, toxic int")
    texts, y = common.sample_labelled(docs, labels, "toxic", F.lit(True), 1000)
    assert len(texts) == 38 and y.sum() == 19 and max(map(len, texts)) < 20
    # a class of long texts alone has the smallest that fit
    labels = spark.createDataFrame([(3, 1), (24, 1), (5, 0)], "doc_id long, toxic int")
    texts, y = common.sample_labelled(docs, labels, "toxic", F.lit(True), 1000, most_bytes=30 << 20)
    assert sorted(map(len, texts)) == [6, 10_000_000] and sorted(y) == [0, 1]
    texts, y = common.sample_labelled(docs, labels, "toxic", F.lit(True), 1000, most_bytes=1 << 20)
    assert len(texts) == 1 and y.tolist() == [0]


def test_sample_of_repeated_keys_and_nulls(spark):
    docs = spark.createDataFrame([(1, None), (1, "b"), (2, "a"), (2, "a"), (None, "c")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    texts, y = common.sample_labelled(docs, labels, "toxic", F.lit(True), 10)
    assert sorted(texts) == ["", "a"] and y.tolist() == [0, 0]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_one_of_repeated_rows(spark, parts):
    rows = [(1, "a b c d e f g", "x", {"k": 1}, 1), (1, "a b c d e f g", "y", {"k": 2}, 2), (1, "a b c d e f g", "z", None, 3), (2, "a b c d e f g", "w", None, 4), (3, "other", None, None, 5)]
    schema = "doc_id long, text string, source string, more map<string,int>, _text_hash int"
    found = set()
    for order in (rows, rows[::-1], [rows[k] for k in (1, 3, 0, 4, 2)]):
        kept = ngram_join.one_of_each(spark.createDataFrame(order, schema).repartition(parts)).collect()
        assert kept[0].asDict().keys() == {"doc_id", "text", "source", "more", "_text_hash"}
        assert sorted(r.doc_id for r in kept) == [1, 3]
        found |= {r.source for r in kept if r.doc_id == 1}
    seen = getattr(test_one_of_repeated_rows, "seen", found)
    test_one_of_repeated_rows.seen = seen
    assert len(found) == 1 and found == seen


def test_score_of_empty_texts_does_not_follow_the_sample():
    for good in (1, 9):
        model = quality.fit(["a fine text of words"] * good + ["!!! ### ???"] * 3, common.np.array([1.0] * good + [0.0] * 3))
        assert model.score(common.pa.array(["", None])).tolist() == [quality.UNDIRECTED] * 2


def test_licences_in_short_and_heads(spark):
    said = {
        "MIT License": "MIT",
        "Apache License Version 2.0, January 2004": "Apache-2.0",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "GPL-3.0",
        "License: MIT": "MIT",
        "licensed under GPLv2 or later": "GPL-2.0",
        "project code under the MIT license": "MIT",
        "The museum was full. All rights reserved seats were gone.": "",
        "Artistic License 2.0": "",
        "SIL OPEN FONT LICENSE Version 1.1": "",
        "Open Database License": "",
        "CC BY-SA 3.0 Unported": "",
    }
    model = licenses.fit([])
    assert model.refused >= licenses.REFUSED - 0.01
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    assert {r.text: r.licences for r in licenses.scan(docs, model).collect()} == said


def test_toxic_terms_alike_in_slices_of_any_size(monkeypatch):
    column = pa.array(["you stupid clown! ", None, "", "a vile river " * 500, "trash!! " * 40] * 30, pa.string())
    terms = np.unique(np.concatenate([toxicity._lexicon_terms(line) for line in toxicity.LEXICONS]))
    found = []
    for size in (1, 700, 1 << 20):
        monkeypatch.setattr(toxicity, "SLICE", size)
        found.append(toxicity._present(column, terms))
    assert found[0].any() and all(np.array_equal(found[0], x) for x in found)
