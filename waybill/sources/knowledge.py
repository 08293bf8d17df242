"""One read of what is known of a day's trains: dated occurrences, route patterns and line excerpts, kept apart."""

from __future__ import annotations

from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Known(NamedTuple):
    """Three frames that are never one, and what stands behind them.

    availability: unsupported (country), missing, damaged, not requested (no day), or ready; with ready, ``coverage`` is the
    day's own: verified, partial or unknown. pattern_status and excerpt_status: loaded, missing, damaged, not applicable.
    """

    availability: str
    coverage: str | None
    occurrences: DataFrame
    patterns: DataFrame
    excerpts: DataFrame
    pattern_status: str
    excerpt_status: str

    def legal_zero(self) -> bool:
        """Whether the day is verified to have no trips. Patterns and excerpts are no trips."""
        return self.coverage == "verified" and self.occurrences.isEmpty()


OCCURRENCES = "country string, service_id string, service_date date, trip_id string"
COVERAGE = "country string, service_date date, status string"
PATTERNS = "pattern_id string, service_id string"
EXCERPTS = "trip_id string, service_dates array<date>"


def _loaded(spark: SparkSession, path: str, schema: str) -> tuple[str, DataFrame]:
    """A table's status and its rows; a table whose files or columns can't be read is damaged and has none."""
    none = spark.createDataFrame([], schema)
    try:
        found = spark.read.parquet(path)
        found = found.select(*[F.col(f.name).cast(f.dataType) for f in none.schema], *[c for c in found.columns if c not in none.columns])
    except AnalysisException as e:
        return ("missing" if e.getCondition() == "PATH_NOT_FOUND" else "damaged"), none
    except Py4JJavaError as e:
        if "CANNOT_READ_FILE_FOOTER" not in str(e) and "FAILED_READ_FILE" not in str(e):  # a lost executor is no damage
            raise
        return "damaged", none
    return "loaded", found


def known(spark: SparkSession, root: str, country: str, day: str | None, services: DataFrame, service: str | None = None, supported: tuple[str, ...] = ("jp",), excerpts_of: tuple[str, ...] = ("jp",)) -> Known:
    """What the tables occurrences, coverage, patterns and excerpts below ``root`` know of a country, a day and a service.

    ``services`` (id, region) tell which patterns are another country's; a pattern of an unknown service stays. Without a day
    no occurrence is asked for, and excerpts of all days are given. A day that coverage does not name is unknown.
    """
    pattern_status, patterns = _loaded(spark, f"{root}/patterns", PATTERNS)
    foreign = services.where(F.col("region") != country).select(F.col("id").alias("service_id"))
    patterns = patterns.join(foreign, "service_id", "left_anti")
    if service is not None:
        patterns = patterns.where(F.col("service_id") == service)
    excerpt_status, excerpts = _loaded(spark, f"{root}/excerpts", EXCERPTS)
    if country not in excerpts_of:
        excerpt_status, excerpts = "not applicable", excerpts.where(F.lit(False))
    elif day is not None:
        excerpts = excerpts.where(F.array_contains("service_dates", F.lit(day).cast("date")))
    status, occurrences = _loaded(spark, f"{root}/occurrences", OCCURRENCES)
    covered, coverage = _loaded(spark, f"{root}/coverage", COVERAGE)
    state = "unsupported" if country not in supported else next((s for s in (status, covered) if s != "loaded"), "ready" if day is not None else "not requested")
    if state != "ready":
        return Known(state, None, occurrences.where(F.lit(False)), patterns, excerpts, pattern_status, excerpt_status)
    of_day = lambda df: df.where((F.col("country") == country) & (F.col("service_date") == F.lit(day).cast("date")))
    own = of_day(occurrences)
    if service is not None:
        own = own.where(F.col("service_id") == service)
    said = of_day(coverage).agg(F.min("status").alias("status"), F.count_distinct("status").alias("n")).first()
    return Known("ready", said.status if said.n == 1 else "unknown", own, patterns, excerpts, pattern_status, excerpt_status)
