"""How much of a network was covered: edges count once however often they were ridden."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_edges(df: DataFrame, key: list[str], km: str, mask: str) -> DataFrame:
    """One row an edge: its least km, and the bits of all its variants."""
    return df.groupBy(*key).agg(F.min(km).alias("km"), F.bit_or(mask).alias("mask"))


def by_category(edges: DataFrame, bits: dict[str, int], digits: int = 2) -> DataFrame:
    """(category, edges, km) and a row ``all``. Categories overlap, so theirs do not add up to it.

    One pass over the edges; the categories that each belongs to come from its mask.
    """
    names = F.array_compact(F.array(F.lit("all"), *[F.when(F.col("mask").bitwiseAND(F.lit(bit)) != 0, name) for name, bit in bits.items()]))
    return edges.select(F.explode(names).alias("category"), "km").groupBy("category").agg(F.count("*").alias("edges"), F.round(F.sum("km"), digits).alias("km"))
