"""Windowed counts of events, the same for tables and streams; a stream adds a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counted(df: DataFrame, window: Column, keys: list[str], late: str | None) -> DataFrame:
    own = df.withWatermark("ts", late) if late else df
    return own.groupBy(window.alias("window"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def tumbling(df: DataFrame, length: str, keys: list[str], late: str | None = None) -> DataFrame:
    return _counted(df, F.window("ts", length), keys, late)


def sessions(df: DataFrame, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    return _counted(df, F.session_window("ts", gap), keys, late)
