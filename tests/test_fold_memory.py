"""Folding holds a few texts of a batch as objects, whatever the batch holds."""

import tracemalloc

import pyarrow as pa

from waybill.functions import text


def test_few_texts_at_once(spark):
    texts = pa.array(["駅Ａb" * 500, None, ""] * 1500)
    tracemalloc.start()
    keys = text.station_key.func(texts)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert keys.to_pylist() == ["駅Ab" * 500, "", ""] * 1500 and most < 3_000_000
    assert text.search_key.func(texts.slice(0, 3)).to_pylist() == ["駅ab" * 500, None, ""] and len(text.search_key.func(texts.slice(0, 0))) == 0
