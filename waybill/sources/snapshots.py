"""Snapshots of a network, from GeoJSON or shapefiles: rows part by part, and their inventory with stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waybill.functions import geo

#: Names under which releases hold an attribute, the first that is there counts.
NAMES = {
    "railway_class_code": ("N02_001", "railway_class_code"),
    "institution_type_code": ("N02_002", "institution_type_code"),
    "line_name": ("N02_003", "line_name", "railway"),
    "operator": ("N02_004", "operator", "operator_name"),
}
STATION_NAMES = {
    "station_name": ("N02_005", "station_name", "name"),
    "station_code": ("N02_005c", "station_code", "n02_station_code"),
    "station_group_code": ("N02_005g", "station_group_code", "n02_group_code"),
}
KIND_NAMES = ("feature_kind", "record_kind", "kind", "type")
STATIONS, SECTIONS = ("station", "stations"), ("section", "sections", "railroadsection")

_FEATURES = "array<struct<id: string, properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
_POINTS = "array<struct<lon: double, lat: double>>"


def geojson_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, feature, part, properties, points) of the GeoJSON documents at ``path``.

    A document is a collection of features, a list of them, or an object with ``sections`` and ``stations``, each a collection
    or a list. Kind is what the properties name, else station if they have a station's name, else that of the collection, else
    section. A feature without an id has its place in its collection. Documents and geometries of another form are in
    ``geojson_rejects``.
    """
    return _parts(spark, path).where("error is null").drop("error")


def geojson_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(file, feature, error) of documents that hold no features and of features that are no points or lines."""
    return _parts(spark, path).where("error is not null").select("file", "feature", "error")


def _parts(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    top = F.from_json("value", "features string, sections string, stations string")
    listed = F.when(F.ltrim("value").startswith("["), F.col("value"))
    nested = lambda c: F.when(F.ltrim(c).startswith("["), c).otherwise(F.get_json_object(c, "$.features"))
    two = top["sections"].isNotNull() | top["stations"].isNotNull()
    held = F.when(two, F.array(*(F.struct(F.lit(kind).alias("fallback"), nested(top[f"{kind}s"]).alias("features")) for kind in ("section", "station")))).otherwise(
        F.array(F.struct(F.lit(None).cast("string").alias("fallback"), F.coalesce(listed, top["features"]).alias("features")))
    )
    collections = texts.select("file", F.explode(held).alias("c"), two.alias("two")).select("file", "two", "c.fallback", F.from_json("c.features", _FEATURES).alias("features"))
    # of two collections one may lack
    empty = collections.where("features is null and not two").select("file", F.lit(None).cast("string").alias("feature"), F.lit("no features").alias("error"))
    found = collections.select("file", "fallback", F.posexplode("features").alias("at", "f"))
    own = found.select(
        "file",
        kind_of(F.col("f.properties"), F.col("fallback")).alias("kind"),
        F.coalesce("f.id", F.col("at").cast("string")).alias("feature"),
        F.coalesce("f.properties", F.expr("cast(map() as map<string,string>)")).alias("properties"),
        F.col("f.geometry.type").alias("form"),
        F.col("f.geometry.coordinates").alias("c"),
    )
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))
    line = lambda ps: F.transform(ps, point)
    parts = (
        F.when(F.col("form") == "Point", F.array(F.array(point(F.from_json("c", "array<double>")))))
        .when(F.col("form") == "LineString", F.array(line(F.from_json("c", "array<array<double>>"))))
        .when(F.col("form") == "MultiLineString", F.transform(F.from_json("c", "array<array<array<double>>>"), line))
    )
    lacking = F.exists("points", lambda p: p["lon"].isNull() | p["lat"].isNull())
    error = (
        F.when(F.col("form").isNull(), "no geometry").when(~F.col("form").isin("Point", "LineString", "MultiLineString"), F.concat(F.lit("geometry of type "), "form"))
        .when(F.col("points").isNull() | (F.size("points") == 0), "no points").when(lacking, "a point lacks a coordinate")
    )
    split = own.withColumn("parts", parts).select("*", F.posexplode_outer("parts").alias("part", "points"))
    rows = split.select("file", "kind", "feature", "part", "properties", F.col("points").cast(_POINTS).alias("points"), error.alias("error"))
    return rows.unionByName(empty, allowMissingColumns=True)


def kind_of(properties: Column, fallback: Column) -> Column:
    """station or section, by what the properties name."""
    named = F.lower(_first(properties, KIND_NAMES))
    has_station = _first(properties, ("N02_005", "station_name")).isNotNull()
    return F.when(named.isin(*STATIONS), "station").when(named.isin(*SECTIONS), "section").when(has_station, "station").otherwise(F.coalesce(fallback, F.lit("section")))


def _first(properties: Column, names: tuple[str, ...]) -> Column:
    """The first value that is neither null nor empty, without NULs and outer blanks."""
    value = lambda n: F.when(F.try_element_at(properties, F.lit(n)) != "", F.try_element_at(properties, F.lit(n)))
    return F.trim(F.replace(F.coalesce(*map(value, names)), F.lit("\0"), F.lit("")))


def inventory(rows: DataFrame) -> DataFrame:
    """(file, feature, part, kind, the attributes of NAMES and STATION_NAMES, geometry, geometry_id, bbox, vertex_count, record_id).

    ``rows`` has file, kind, feature, part, properties and points. Geometry is JSON text in seven decimals in that of both
    directions which comes first as text, so a line and its reverse have one geometry_id. record_id is a digest of kind,
    attributes and geometry_id; of several records of a file with one id, each has -001, -002 and so on, by feature and part,
    features that are numbers by value. Rows without points are left out. Ties at the eighth decimal go to the even
    digit of the decimal text.
    """
    own = rows.where(F.size("points") > 0)
    values = {name: _first(F.col("properties"), names) for name, names in NAMES.items()}
    values |= {name: F.when(F.col("kind") == "station", _first(F.col("properties"), names)) for name, names in STATION_NAMES.items()}
    own = own.withColumns(values).withColumn("geometry", geo.undirected_json(F.col("points")))
    own = own.withColumn("geometry_id", geo.geometry_id(F.col("geometry")))
    lon, lat = F.transform("points", lambda p: F.bround(p["lon"], 7)), F.transform("points", lambda p: F.bround(p["lat"], 7))
    attributes = lambda names: F.struct(*(F.col(n) for n in sorted(names)))
    identity = lambda names: F.to_json(F.struct(attributes(names).alias("attributes"), "geometry_id", "kind"), {"ignoreNullFields": "false"})
    text = F.when(F.col("kind") == "station", identity([*NAMES, *STATION_NAMES])).otherwise(identity([*NAMES]))
    base = F.concat("kind", F.lit("-"), F.substring(F.sha2(text, 256), 1, 24))
    told = own.select(
        "file", "feature", "part", "kind", *values, "geometry", "geometry_id",
        F.array(F.array_min(lon), F.array_min(lat), F.array_max(lon), F.array_max(lat)).alias("bbox"),
        F.size("points").alias("vertex_count"), base.alias("base"),
    )
    same = Window.partitionBy("file", "base")
    order = [F.col("feature").try_cast("long"), F.col("feature").cast("string"), "part"]
    number = F.when(F.count("*").over(same) > 1, F.format_string("-%03d", F.row_number().over(same.orderBy(*order))))
    return told.withColumn("record_id", F.concat("base", F.coalesce(number, F.lit("")))).drop("base")


def identities(records: DataFrame) -> DataFrame:
    """(file, kind, operator, line_name, geometry_ids, station_names) of an inventory: what a line consists of, as sorted sets.

    A line of a file is its sections and stations: as many as a railway line has, so the sets stay small.
    """
    sets = [F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("geometry_id", "station_name")]
    return records.groupBy("file", "kind", "operator", "line_name").agg(*sets)
