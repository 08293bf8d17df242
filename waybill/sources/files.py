"""Readers and writers of feed files as DataFrames.

Zip archives and GeoJSON documents are split by file, so many files are many tasks; within a file rows stream.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a zipped table that a task holds at once.
_ROWS = 20_000


def gtfs_table(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """(feed, columns...) of ``table``.txt in the zip archives at ``path``, all texts.

    Byte order marks and white space around names and values go; short rows are padded with nulls, empty values are null;
    a column or table that a feed lacks gives nulls or no rows. Quoted values may hold line breaks. The table may lie in any
    folder of the archive: the one nearest to the root counts, of several the first by name. Bytes that are no UTF-8
    become replacement characters.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for feed, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    members = [n for n in z.namelist() if n.rpartition("/")[2] == f"{table}.txt"]
                    if not members:
                        continue
                    with z.open(min(members, key=lambda n: (n.count("/"), n))) as raw:
                        lines = csv.reader(io.TextIOWrapper(raw, "utf-8-sig", errors="replace", newline=""), skipinitialspace=True)
                        names = [n.strip() for n in next(lines, [])]
                        place = [names.index(c) if c in names else -1 for c in columns]
                        held = []
                        for line in lines:
                            if line:
                                held.append([feed, *[(line[k].strip() or None) if 0 <= k < len(line) else None for k in place]])
                            if len(held) == _ROWS:
                                yield pd.DataFrame(held, columns=["feed", *columns])
                                held = []
                        yield pd.DataFrame(held, columns=["feed", *columns])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, T.StructType([T.StructField(c, T.StringType()) for c in ("feed", *columns)]))


def geojson_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """(id, properties, kind, points) of the features at ``path``; ``properties`` is their schema. Points are (lon, lat) of all
    parts in order, whatever the geometry's nesting; a feature without geometry has none."""
    geometry = "struct<type: string, coordinates: string>"
    schema = f"features array<struct<id: string, properties: struct<{properties}>, geometry: {geometry}>>"
    found = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return found.select("f.id", "f.properties", F.col("f.geometry.type").alias("kind"), coordinates(F.col("f.geometry.coordinates")).alias("points"))


def coordinates(text: Column) -> Column:
    """All (lon, lat) pairs of a GeoJSON coordinates value given as JSON text, in order: its innermost lists."""
    number = r"-?[0-9.]+(?:[eE][-+]?[0-9]+)?"
    pairs = F.regexp_extract_all(text, F.lit(rf"\\[\\s*({number})\\s*,\\s*({number})".replace("\\\\", "\\")), F.lit(0))
    return F.transform(pairs, lambda p: F.struct(*(F.regexp_extract(p, number, 0).cast("double").alias("lon"), F.regexp_extract(p, rf",\s*({number})", 1).cast("double").alias("lat"))))


def package_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, name_en, stations) of a compact package: {"lines": [[id, name, name_en, [[code, lon, lat], ...]], ...]}.

    Positional arrays of mixed types are read as JSON texts and cast place by place; a missing place is null.
    """
    raw = spark.read.schema("lines array<array<string>>").json(path, multiLine=True).select(F.explode("lines").alias("l"))
    at = lambda k: F.get("l", F.lit(k))
    stations = F.transform(
        F.from_json(at(3), "array<array<string>>"),
        lambda s: F.struct(F.get(s, F.lit(0)).alias("code"), F.get(s, F.lit(1)).cast("double").alias("lon"), F.get(s, F.lit(2)).cast("double").alias("lat")),
    )
    return raw.select(at(0).alias("id"), at(1).alias("name"), at(2).alias("name_en"), stations.alias("stations"))


def ledger(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Rows of JSON-lines files, with their file; what a schema does not name is left out, and lines that don't parse are in ``ledger_rejects``."""
    return _lines(spark, glob, schema).where("r is not null and r._bad is null").select("r.*", "file").drop("_bad")


def ledger_rejects(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """(file, line) of the lines that ``ledger`` leaves out: those that are no JSON object or hold a value that the schema can't take."""
    return _lines(spark, glob, schema).where("r is null or r._bad is not null").select("file", "line")


def _lines(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    lines = spark.read.text(glob).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")).where("trim(line) <> ''")
    return lines.withColumn("r", F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))


def canonical_json(columns: list[str]) -> Column:
    """A row as JSON with its keys in order and no blanks; nulls are kept, so equal rows give equal texts."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key, the first in order: what a batch of inserts that ignore known keys leaves."""
    return df.withColumn("_first", F.min(F.struct(*order)).over(_by(keys))).where(F.struct(*order).eqNullSafe(F.col("_first"))).drop("_first").dropDuplicates(keys)


def _by(keys: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def write_changed_parts(new: DataFrame, path: str, part: str, key: str) -> dict[str, list[str]]:
    """Writes the parts (days) of ``new`` that differ from those at ``path``, and deletes those that ``new`` lacks.

    Parts are compared by digests, one aggregate a side; only changed ones are read and written, by dynamic partition
    overwrite. Returns the parts by action. The list of parts is small: one a day.
    """
    from pyspark.errors import AnalysisException

    from waybill.operators import relations

    spark = new.sparkSession
    try:
        old = spark.read.schema(new.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # any other fault must not look like an empty table
            raise
        old = spark.createDataFrame([], new.schema)
    columns = [c for c in new.columns if c not in (part, key)]
    found: dict[str, list[str]] = {}
    for r in relations.upsert_plan(old, new, part, key, columns).collect():
        found.setdefault(r.action, []).append(r[part])
    write = found.get("new", []) + found.get("changed", [])
    if write:
        new.where(F.col(part).isin(write)).repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for day in found.get("vanished", []):
        gone = hadoop.Path(f"{path}/{part}={day}")
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return {k: sorted(v) for k, v in found.items()}
