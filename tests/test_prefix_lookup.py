"""Names that lead texts: broadcast ones and shuffled ones are the same, and texts are dealt by their number."""

from waybill.operators import search


def test_few_and_many_names(spark):
    texts = spark.createDataFrame([(1, "ab cd(e"), (2, "ab cd"), (3, "abc d"), (4, ""), (5, None), (6, "ab(x"), (6, "ab(x")], "id int, whole string")
    names = spark.createDataFrame([("ab",), ("ab cd",), ("ab cd",), ("abc d",), (None,), ("ab c",)], "n string")
    few, many = (sorted((r.id, r.name) for r in search.longest_prefix(texts, "whole", names, "n", few=k).collect()) for k in (100, 0))
    assert few == many == [(1, "ab cd"), (2, "ab cd"), (3, "abc d"), (6, "ab")]
