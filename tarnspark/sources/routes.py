"""Route files: GPX and GeoJSON in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PT = "array<struct<_lat string, _lon string, ele string>>"
_GPX = f"struct<metadata struct<name string>, trk array<struct<name string, trkseg array<struct<trkpt {_PT}>>>>, rte array<struct<name string, rtept {_PT}>>, wpt {_PT}>"


def route_format_detect(text: Column) -> Column:
    """geojson if the first visible character is { or [, gpx for other content; an empty file raises."""
    bare = F.regexp_replace(text, r"^[\s﻿]+", "")
    return F.when(bare == "", F.raise_error(F.lit("empty route file"))).when(bare.rlike(r"^[{\[]"), "geojson").otherwise("gpx")


def read_route_files(spark: SparkSession, path: str) -> DataFrame:
    """file and text of each route file, whole."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1).alias("file"), F.col("value").alias("text"))


def _points(raw: Column) -> Column:
    made = F.transform(raw, lambda p: F.struct(p["_lon"].try_cast("double").alias("lng"), p["_lat"].try_cast("double").alias("lat"), p["ele"].try_cast("double").alias("ele")))
    return F.filter(made, lambda p: F.abs(p["lng"]).between(0, 180) & F.abs(p["lat"]).between(0, 90))


def scan_route_xml(files: DataFrame) -> DataFrame:
    """file, name, coords <lng, lat, ele> and waypoints of GPX texts: track points, else route points, else the waypoints.

    Namespace prefixes go first; points without coordinates in range are skipped; the name is the track's, then the
    file's own, then the file name.
    """
    plain = F.regexp_replace("text", r"(</?)[A-Za-z_][\w.-]*:", "$1")
    g = files.select("file", F.from_xml(plain, _GPX, {"rowTag": "gpx", "mode": "PERMISSIVE"}).alias("g"))
    none = F.array().cast(_PT)
    track = F.flatten(F.transform(F.coalesce("g.trk", F.array()), lambda t: F.flatten(F.transform(F.coalesce(t["trkseg"], F.array()), lambda s: F.coalesce(s["trkpt"], none)))))
    route = F.flatten(F.transform(F.coalesce("g.rte", F.array()), lambda r: F.coalesce(r["rtept"], none)))
    p = g.select("file", "g", _points(track).alias("t"), _points(route).alias("r"), _points(F.coalesce("g.wpt", none)).alias("waypoints"))
    line = F.when(F.size("t") > 0, F.col("t")).when(F.size("r") > 0, F.col("r")).otherwise(F.col("waypoints"))
    name = F.coalesce(F.get("g.trk", F.lit(0))["name"], F.col("g.metadata.name"), F.col("file"))
    return p.select("file", name.alias("name"), line.alias("coords"), "waypoints")


def scan_route_geojson(files: DataFrame) -> DataFrame:
    """file, name, coords and waypoints of GeoJSON texts: the first line (parts joined), and all points."""
    j = files.select("file", F.parse_json("text").alias("j"))
    kind = lambda v, p: F.try_variant_get(v, p, "string")
    wrapped = F.when(kind("j", "$.type") == "FeatureCollection", F.try_variant_get("j", "$.features", "array<variant>")).otherwise(F.array("j"))
    f = j.select("file", F.posexplode(wrapped).alias("pos", "f"))
    geometry = F.coalesce(F.try_variant_get("f", "$.geometry", "variant"), F.col("f"))
    f = f.select("file", "pos", geometry.alias("g"), kind("f", "$.properties.name").alias("name"))
    t = kind("g", "$.type")
    coords = F.when(t == "LineString", F.try_variant_get("g", "$.coordinates", "array<array<double>>")).when(
        t == "MultiLineString", F.flatten(F.try_variant_get("g", "$.coordinates", "array<array<array<double>>>"))
    )
    point = F.when(t == "Point", F.try_variant_get("g", "$.coordinates", "array<double>"))
    made = lambda a: F.struct(F.get(a, F.lit(0)).alias("lng"), F.get(a, F.lit(1)).alias("lat"), F.get(a, F.lit(2)).alias("ele"))
    f = f.select("file", "pos", "name", F.transform(coords, made).alias("line"), F.when(point.isNotNull(), made(point)).alias("point"))
    first = F.min_by(F.struct("line", "name"), F.when(F.col("line").isNotNull(), F.col("pos")))
    return f.groupBy("file").agg(first.alias("r"), F.transform(F.array_sort(F.collect_list(F.when(F.col("point").isNotNull(), F.struct("pos", "point")))), lambda x: x["point"]).alias("waypoints")).select(
        "file", F.coalesce("r.name", "file").alias("name"), F.col("r.line").alias("coords"), "waypoints"
    )


def _escaped(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(kind)) if name in df.columns else F.array().cast(kind)


_WAYPOINTS = "array<struct<lng double, lat double, ele double, name string>>"
_SPANS = "array<struct<kind string, start bigint, end bigint>>"


def sink_route_gpx(routes: DataFrame, path: str) -> None:
    """One GPX text a row: route_id (as a folder), coordinates at 7 decimals, heights at 1.

    ``waypoints`` <lng, lat, ele, name> and ``spans`` <kind, start, end> (where each leg lies in ``coords``) are written if
    there are such columns: waypoints before the track, spans in the track's extensions.
    """
    waypoint = lambda p: F.concat(
        F.format_string('<wpt lat="%.7f" lon="%.7f">', p["lat"], p["lng"]), F.when(p["ele"].isNotNull(), F.format_string("<ele>%.1f</ele>", p["ele"])).otherwise(""),
        F.when(p["name"].isNotNull(), F.concat(F.lit("<name>"), _escaped(p["name"]), F.lit("</name>"))).otherwise(""), F.lit("</wpt>"),
    )
    leg = lambda s: F.format_string('<legs:leg kind="%s" start="%d" end="%d"/>', s["kind"], s["start"], s["end"])
    spans = _optional(routes, "spans", _SPANS)
    legs = F.when(F.size(spans) > 0, F.concat(F.lit("<extensions><legs:legs>"), F.array_join(F.transform(spans, leg), ""), F.lit("</legs:legs></extensions>"))).otherwise("")
    pt = lambda p: F.concat(F.format_string('<trkpt lat="%.7f" lon="%.7f">', p["lat"], p["lng"]), F.when(p["ele"].isNotNull(), F.format_string("<ele>%.1f</ele>", p["ele"])).otherwise(""), F.lit("</trkpt>"))
    body = F.concat(
        F.lit('<?xml version="1.0"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1" xmlns:legs="urn:tarnspark:legs">'),
        F.array_join(F.transform(_optional(routes, "waypoints", _WAYPOINTS), waypoint), ""), F.lit("<trk><name>"), _escaped(F.col("name")), F.lit("</name>"), legs, F.lit("<trkseg>"),
        F.array_join(F.transform("coords", pt), ""), F.lit("</trkseg></trk></gpx>"),
    )
    routes.select("route_id", body.alias("value")).write.partitionBy("route_id").text(path)


def sink_route_geojson(routes: DataFrame, path: str) -> None:
    """One GeoJSON feature collection a row: the line, with its ``spans`` if there are any, and ``waypoints``.

    Heights are the third ordinate, to 0.1 m. A waypoint without a name is numbered.
    """
    pt = lambda p: F.when(p["ele"].isNull(), F.array(F.round(p["lng"], 7), F.round(p["lat"], 7))).otherwise(F.array(F.round(p["lng"], 7), F.round(p["lat"], 7), F.round(p["ele"], 1)))
    shape = F.struct(F.lit("LineString").alias("type"), F.transform("coords", pt).alias("coordinates"))
    spans = _optional(routes, "spans", _SPANS)
    held = F.struct(F.col("name"), F.lit("route").alias("kind"), F.when(F.size(spans) > 0, spans).alias("legs"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), held.alias("properties")))
    point = lambda p, i: F.to_json(
        F.struct(
            F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(F.round(p["lng"], 7), F.round(p["lat"], 7)).alias("coordinates")).alias("geometry"),
            F.struct(F.coalesce(p["name"], F.format_string("Waypoint %d", i + 1)).alias("name"), F.lit("waypoint").alias("kind"), p["ele"].alias("ele")).alias("properties"),
        )
    )
    features = F.array_join(F.concat(F.array(feature), F.transform(_optional(routes, "waypoints", _WAYPOINTS), point)), ",")
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), features, F.lit("]}"))
    routes.select("route_id", text.alias("value")).write.partitionBy("route_id").text(path)
