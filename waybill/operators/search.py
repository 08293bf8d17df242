"""Ranked suggestions, facets, groups and greedy elections over names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions import text as texts
from waybill.operators import rounds


def best(df: DataFrame, rank: Column, order: list, most: int) -> DataFrame:
    """The rows with a rank, best first, at most so many; ``place`` counts them. The limit comes before the numbering."""
    top = df.withColumn("rank", rank).where("rank is not null").orderBy("rank", *order).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy("rank", *order)))


def capped(df: DataFrame, section: str, order: list, a_section: int, in_all: int) -> DataFrame:
    """At most so many rows a section, and of those so many in all, sections in order."""
    own = df.withColumn("_k", F.row_number().over(Window.partitionBy(section).orderBy(*order))).where(F.col("_k") <= a_section)
    return own.orderBy(section, "_k").limit(in_all).drop("_k")


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) of each column's values, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count("*").alias("n"))


def first_seen_groups(df: DataFrame, name: Column, order: str) -> DataFrame:
    """(name, first, n, place): groups in the order in which their first row comes."""
    by = df.groupBy(name.alias("name")).agg(F.min(order).alias("first"), F.count("*").alias("n"))
    return by.withColumn("place", F.row_number().over(Window.orderBy("first")))


def elected(df: DataFrame, group: str, order: list, id_: str) -> DataFrame:
    """One row a group: the first in order."""
    return df.groupBy(group).agg(F.min_by(id_, F.struct(*order)).alias("winner"), F.count("*").alias("members"))


def homonyms(df: DataFrame, key: Column, id_: str) -> DataFrame:
    """(key, ids) of keys that two or more ids share."""
    return df.groupBy(key.alias("key")).agg(F.count_distinct(id_).alias("ids")).where("ids > 1")


def longest_prefix(df: DataFrame, text: str, names: DataFrame, name: str, few: int = 100_000) -> DataFrame:
    """Each text with the longest name that it begins with and that an end, a space or a bracket follows.

    Names meet texts by the prefixes at such places, an equi-join however many names there are; ``few`` names are broadcast,
    so that texts that share a short name stay where they are. Of a name only its length goes on; partitions follow the texts.
    """
    known = rounds.settled(names.select(F.col(name).alias("_p")).distinct())
    ends = F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: (i == F.length(text)) | F.substring(F.col(text), i + 1, F.lit(1)).isin(" ", "("))
    cut = df.withColumn("_p", F.explode(F.transform(ends, lambda i: F.substring(F.col(text), F.lit(1), i))))
    met = cut.join(F.broadcast(known) if known.count() <= few else known, "_p").select(*df.columns, F.length("_p").alias("_n"))
    found = rounds.dealt(met, *df.columns, count=df.count()).groupBy(*df.columns).agg(F.max("_n").alias("_n"))
    return found.select(*df.columns, F.substring(F.col(text), F.lit(1), F.col("_n")).alias("name"))


def journeys(df: DataFrame, query: str, operators: DataFrame, fields: str = "fields", plain: list[str] | None = None, synonyms: list[list[str]] | None = None) -> DataFrame:
    """The journeys that answer a query. ``df`` has region, operator_ids and ``fields``, an array of texts.

    Where the query is in the name of an operator (region, id, name) of the journey's region, only the operators decide: one of
    them must be among operator_ids. Elsewhere a field must hold the whole query, or all its words, folded and with
    ``synonyms`` (lists of equal names); or one of the ``plain`` columns (dates, ids) holds it as written, in any case. A
    blank query is answered by all, one of marks alone by none.
    """
    needle = query.strip()
    if not needle:
        return df
    spark = df.sparkSession
    names = [n for group in synonyms or [] for n in group]
    asked = [needle, *texts.words_by_script(needle), *names]
    folded = [r.k for r in spark.createDataFrame([(i, w) for i, w in enumerate(asked)], "i int, w string").select("i", texts.variant_key(F.col("w")).alias("k")).orderBy("i").collect()]
    whole, words, keys = folded[0], [w for w in folded[1 : len(asked) - len(names)] if w], iter(folded[len(asked) - len(names) :])
    if not whole:
        return df.where(F.lit(False))
    equal = [[next(keys) for _ in group] for group in synonyms or []]

    def held(value: Column, word: str) -> Column:
        out = value.contains(word)
        for other in sorted({word.replace(n, m) for group in equal for n in group if n and n in word for m in group} - {word}):
            out = out | value.contains(other)
        return out

    def field_hit(value: Column) -> Column:
        out = held(value, whole)
        if words and words != [whole]:
            every = F.lit(True)
            for w in words:
                every = every & held(value, w)
            out = out | every
        return out

    named = operators.where(texts.variant_key(F.col("name")).contains(whole)).groupBy("region").agg(F.array_agg("id").alias("_asked"))
    joined = df.join(named, "region", "left").withColumn("_folded", texts.variant_keys(F.col(fields)))
    by_text = F.exists("_folded", field_hit)
    for c in plain or []:
        by_text = by_text | F.coalesce(F.lower(F.col(c).cast("string")).contains(needle.lower()), F.lit(False))
    hit = F.when(F.col("_asked").isNotNull(), F.arrays_overlap("operator_ids", "_asked")).otherwise(by_text)
    return joined.where(F.coalesce(hit, F.lit(False))).select(*df.columns)
