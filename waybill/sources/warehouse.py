"""Tables published together: readers see all of a release or none of it, and a dry run tells what a synchronisation would change."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(ValueError):
    """A release that would break a key or a reference, a stale table in a dry run, or a release beside another one."""


def _hadoop(spark: SparkSession, path: str):
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return fs, fs.Path(path), fs.Path(path).getFileSystem(conf), conf


def catalog(spark: SparkSession, root: str) -> dict:
    """{"release": name, "tables": {table: {"path", "rows"}}} of the current release; without one no tables."""
    _, path, files, _ = _hadoop(spark, f"{root}/CURRENT")
    if not files.exists(path):
        return {"release": None, "tables": {}}
    return json.loads("\n".join(r.value for r in spark.read.text(f"{root}/CURRENT", wholetext=True).collect()))


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the current release."""
    return spark.read.parquet(catalog(spark, root)["tables"][name]["path"])


def publish(
    spark: SparkSession,
    root: str,
    tables: dict[str, DataFrame],
    keys: dict[str, list[str]] | None = None,
    references: list[tuple[str, str, str, str]] | None = None,
    seen: str | None = None,
) -> dict:
    """Writes ``tables`` to a new folder, checks them as written, then names them in CURRENT by one rename.

    ``keys`` are unique and without nulls; ``references`` (table, column, other, its column) hold for values that are not
    null, among the new tables and those that stay. A table that is not given stays as it is. With ``seen``, the release
    that the caller has read, another one in between is refused. Whatever fails leaves the last release in force.
    """
    before = catalog(spark, root)
    if seen is not None and before["release"] != seen:
        raise Refused(f"release {before['release']} came after {seen}")
    release = uuid.uuid4().hex
    folder = f"{root}/releases/{release}"
    found = dict(before["tables"])
    try:
        for name, frame in tables.items():
            path = f"{folder}/{name}"
            frame.write.parquet(path)
            found[name] = {"path": path, "rows": spark.read.schema(frame.schema).parquet(path).count()}
        read = {name: spark.read.parquet(t["path"]) for name, t in found.items()}
        for name, columns in (keys or {}).items():
            null = F.lit(False)
            for c in columns:
                null = null | F.col(c).isNull()
            bad = read[name].groupBy(*columns).count().where(null | (F.col("count") > 1))
            if not bad.isEmpty():
                raise Refused(f"{name}: {columns} is no key")
        for name, column, other, its in references or []:
            left = read[name].where(F.col(column).isNotNull()).select(F.col(column).alias("_v"))
            if not left.join(read[other].select(F.col(its).alias("_v")), "_v", "left_anti").isEmpty():
                raise Refused(f"{name}.{column} names rows that {other}.{its} lacks")
        if catalog(spark, root)["release"] != before["release"]:
            raise Refused("another release came in between")
    except Exception:
        _, path, files, _ = _hadoop(spark, folder)
        files.delete(path, True)
        raise
    now = {"release": release, "tables": found}
    fs, draft, files, conf = _hadoop(spark, f"{root}/CURRENT.{release}")
    out = files.create(draft, True)
    out.write(bytearray(json.dumps(now, sort_keys=True).encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    over[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(draft.toUri(), conf).rename(draft, fs.Path(f"{root}/CURRENT"), over)
    return now


def changes(expected: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, action): insert, update or delete. Keys are compared with nulls equal, and so are all other columns of ``expected``."""
    others = [c for c in expected.columns if c not in keys]
    side = lambda df, n: df.select(*[F.col(k).alias(f"{n}_{k}") for k in keys], F.struct(F.lit(True).alias("_is"), *others).alias(n))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"e_{k}").eqNullSafe(F.col(f"c_{k}"))
    both = side(expected, "e").join(side(current, "c"), on, "full")
    action = F.when(F.col("c").isNull(), "insert").when(F.col("e").isNull(), "delete").when(~F.col("e").eqNullSafe(F.col("c")), "update")
    return both.select(*[F.when(F.col("e").isNull(), F.col(f"c_{k}")).otherwise(F.col(f"e_{k}")).alias(k) for k in keys], action.alias("action")).where("action is not null")


def sync(expected: DataFrame, root: str, name: str, keys: list[str], scope: Column | None = None, check: bool = False) -> dict[str, int]:
    """Makes the published table ``name`` equal ``expected`` within ``scope``; rows beyond it stay. Returns the rows by action.

    With ``check`` nothing is written and a table that would change is refused, with the counts. Without changes there is
    no new release. A key twice in ``expected``, or a null in one, is refused where something is to be written.
    """
    spark = expected.sparkSession
    held = catalog(spark, root)
    columns = expected.columns
    current = table(spark, root, name).select(*columns) if name in held["tables"] else spark.createDataFrame([], expected.schema)
    inside = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    if not expected.where(~inside).isEmpty():
        raise Refused(f"{name}: rows out of scope")
    done = {r.action: r.n for r in changes(expected, current.where(inside), keys).groupBy("action").agg(F.count("*").alias("n")).collect()}
    if check and done:
        raise Refused(f"{name} is stale: {dict(sorted(done.items()))}")
    if done:
        publish(spark, root, {name: expected.unionByName(current.where(~inside))}, {name: keys}, seen=held["release"])
    return done
