"""Tag classifiers: each adds a kind and, where rows can fall out, the reason.

Inputs are feature tables with one column per tag (null where the tag is absent). All of these are projections.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnspark.functions.geo import MAX_LATITUDE
from tarnspark.functions.naming import list_membership
from tarnspark.functions.numbers import parse_elevation, parse_grade, parse_grade_number, parse_number_strict, parse_population, round_exact
from tarnspark.operators.aggregates import mark_first

# The tag vocabularies of the published datasets.
LANDMARK_KINDS = ("mast", "tower", "survey_point", "cairn", "lighthouse")
TOWER_TYPES_DROPPED = (
    "lighting", "lightning_protection", "siren", "transition", "advertising", "climbing", "diving", "firefighter_training", "hose", "training",
)
SURVEY_STRUCTURES_DROPPED = (
    "medallion", "pin", "indented_pin", "cut", "plaque", "rod", "pipe", "bracket", "bolt", "disc", "plate", "rivet",
)
SUMMITS = ("peak", "volcano")
PARKING_OPEN = ("yes", "permissive", "destination", "public", "unknown", "customers")
GARAGES = ("garage_boxes", "garage", "carports", "sheds")
BARRIERS = {"wall": "wall", "fence": "fence", "gate": "gate", "kissing_gate": "gate", "stile": "stile", "cattle_grid": "cattle_grid"}
POWER = {"line": "power_line", "minor_line": "minor_power_line", "tower": "pylon"}
DETAIL_MIN_ZOOM = {
    "power_line": 12, "minor_power_line": 14, "wall": 14, "fence": 14, "ford": 14, "pylon": 15, "gate": 15, "stile": 15, "cattle_grid": 15,
}
DETAIL_POINTS = ("pylon", "gate", "stile", "cattle_grid", "ford")
TERRAIN_KINDS = ("scree", "shingle", "rock", "stone")
PLACE_RANKS = {
    "city": 60, "town": 50, "village": 40, "suburb": 35, "hamlet": 30, "peak": 25, "volcano": 25, "saddle": 12, "mountain_pass": 12,
}
SETTLEMENTS = ("city", "town", "village", "hamlet", "suburb")
WALKABLE = ("path", "minor_road", "medium_road", "major_road")


def lookup(key: Column, table: dict) -> Column:
    return reduce(lambda c, kv: c.when(key == kv[0], kv[1]), table.items(), F)


def tag_expression(text: str) -> Column:
    """A filter from ``types/key=v1,v2`` or ``types/key``; types are n, w and r, read from ``osm_type``."""
    types, _, rest = text.partition("/")
    key, _, values = rest.partition("=")
    kinds = [{"n": "node", "w": "way", "r": "relation"}[t] for t in types]
    value = F.col(f"tag_{key.replace(':', '_')}")
    match = value.isin(*values.split(",")) if values else value.isNotNull()
    return F.col("osm_type").isin(*kinds) & F.coalesce(match, F.lit(False))


def feature_tags(features: DataFrame, keys: list[str]) -> DataFrame:
    """``features`` with a column for each tag of its ``props`` (VARIANT), and with osm_type and osm_id from ``@type`` and ``@id``.

    ``tag_<key>`` holds a JSON string and nothing else: 4 is not ``"4"``. ``num_<key>`` holds a JSON number, and ``ids`` of
    either type are read as text. Colons in keys become underscores. These are the flat columns that the classifiers take.
    """
    value = lambda k: F.try_variant_get("props", f"$['{k}']", "variant")
    text = lambda k: F.when(F.schema_of_variant(value(k)) == "STRING", F.try_variant_get("props", f"$['{k}']", "string"))
    plain = lambda k: F.try_variant_get("props", f"$['{k}']", "string")
    name = lambda k: k.replace(":", "_")
    tags = [c for k in keys for c in (text(k).alias(f"tag_{name(k)}"), parse_number_strict(value(k)).alias(f"num_{name(k)}"))]
    return features.select("*", plain("@type").alias("osm_type"), plain("@id").alias("osm_id"), text("name").alias("name"), *tags)


def tag_filter(features: DataFrame, expressions: list[str]) -> DataFrame:
    """Features that any of the expressions keeps; no expression keeps nothing."""
    return features.where(reduce(lambda a, b: a | b, map(tag_expression, expressions), F.lit(False)))


def shared_subset(features: DataFrame, union: list[str], stages: dict[str, list[str]]) -> DataFrame:
    """One pass for all stages; a stage that asks for more than the union is refused."""
    for name, wanted in stages.items():
        if missing := sorted(set(wanted) - set(union)):
            raise ValueError(f"{name} needs {missing}, which the shared subset does not keep")
    return tag_filter(features, union)


def peaks_normalize(features: DataFrame) -> DataFrame:
    """``ele`` parsed or null, ``lists`` set where ``tag_munro`` is yes; a number in ``num_ele`` counts like its text."""
    munro = F.col("tag_munro") == "yes" if "tag_munro" in features.columns else F.lit(False)
    ele = parse_elevation(F.col("tag_ele"))
    if "num_ele" in features.columns:
        ele = F.coalesce(ele, F.when(F.col("num_ele").between(-500, 9000), round_exact(F.col("num_ele"), 1)))
    return features.withColumn("ele", ele).withColumn("lists", F.when(munro, "munro"))


def landmarks_classify(features: DataFrame) -> DataFrame:
    """``kind`` or ``reason``: unrecognized, summit, not_a_landmark, tested in this order."""
    has = lambda c: F.col(c) if c in features.columns else F.lit(None).cast("string")
    turbine = (has("tag_power") == "generator") & (has("tag_generator_source") == "wind")
    kind = F.when(F.col("tag_man_made").isin(*LANDMARK_KINDS), F.col("tag_man_made")).when(turbine, "wind_turbine")
    street = (kind.isin("mast", "tower") & has("tag_tower_type").isin(*TOWER_TYPES_DROPPED)) | (
        (kind == "survey_point") & has("tag_survey_point_structure").isin(*SURVEY_STRUCTURES_DROPPED)
    )
    reason = F.when(kind.isNull(), "unrecognized").when(has("tag_natural").isin(*SUMMITS), "summit").when(street, "not_a_landmark")
    return features.withColumn("reason", reason).withColumn("kind", F.when(F.col("reason").isNull(), kind))


def parking_classify(features: DataFrame) -> DataFrame:
    """``keep``, ``customers`` and ``reason`` (unrecognized, restricted, garages) of car parks."""
    opens = F.coalesce(F.col("tag_access"), F.lit("")).isin("", *PARKING_OPEN)
    reason = (
        F.when(~F.coalesce(F.col("tag_amenity") == "parking", F.lit(False)), "unrecognized")
        .when(~opens, "restricted").when(F.col("tag_parking").isin(*GARAGES), "garages")
    )
    out = features.withColumn("reason", reason).withColumn("keep", F.col("reason").isNull())
    return out.withColumn("customers", F.col("keep") & F.coalesce(F.col("tag_access") == "customers", F.lit(False)))


def detail_classify(features: DataFrame) -> DataFrame:
    """``kind`` from barrier, then power, then ford; ``minzoom`` and ``is_point`` follow the kind."""
    kind = F.coalesce(lookup(F.col("tag_barrier"), BARRIERS), lookup(F.col("tag_power"), POWER), F.when(F.col("tag_ford") != "no", "ford"))
    out = features.withColumn("kind", kind)
    return out.withColumn("minzoom", lookup(F.col("kind"), DETAIL_MIN_ZOOM)).withColumn("is_point", F.col("kind").isin(*DETAIL_POINTS))


def detail_shape(classified: DataFrame) -> DataFrame:
    """``shape``: point, midpoint or line, or misshapen where a line kind is mapped as a point; other geometry raises."""
    shape = (
        F.when(~F.col("geom_type").isin("Point", "LineString"), F.raise_error(F.concat(F.lit("unexpected geometry "), F.col("geom_type"))))
        .when(F.col("is_point") & (F.col("geom_type") == "Point"), "point").when(F.col("is_point"), "midpoint")
        .when(F.col("geom_type") == "LineString", "line").otherwise("misshapen")
    )
    return classified.withColumn("shape", F.when(F.col("kind").isNotNull(), shape))


def terrain_features_classify(features: DataFrame) -> DataFrame:
    return features.where(F.col("tag_natural").isin(*TERRAIN_KINDS)).withColumn("kind", F.col("tag_natural"))


def trail_grade(lines: DataFrame, key: str = "osm_id", order: str = "src_ord") -> DataFrame:
    """The first line of each key, with grade ``t`` or the reason it has none: untagged, duplicate, unreadable.

    Duplicates are found before any grade is read; a line without a key is never one. A number in ``num_grade`` is a tag too,
    and its whole part the grade.
    """
    number = F.col("num_grade") if "num_grade" in lines.columns else F.lit(None).cast("double")
    tagged = lines.withColumn("__tagged", F.col("tag_grade").isNotNull() | number.isNotNull())
    marked = mark_first(tagged, [key], order, when=F.col("__tagged"))
    grade = F.coalesce(parse_grade(F.col("tag_grade")), parse_grade_number(number))
    reason = F.when(~F.col("__tagged"), "untagged").when(~F.col("is_first"), "duplicate").when(grade.isNull(), "unreadable")
    return marked.withColumn("reason", reason).withColumn("t", F.when(F.col("reason").isNull(), grade)).drop("__tagged", "is_first")


def paths_reduce(lines: DataFrame, highway: str = "highway") -> DataFrame:
    """Lines with a highway: ``kind`` track or path, ``kind_detail`` the tag itself."""
    return lines.where(F.col(highway).isNotNull()).withColumn("kind_detail", F.col(highway)).withColumn(
        "kind", F.when(F.col(highway) == "track", "track").otherwise("path")
    )


def place_classify(features: DataFrame) -> DataFrame:
    """Named points that are a settlement, a summit or saddle, or a pass; population for settlements only."""
    has = lambda c: F.col(c) if c in features.columns else F.lit(None).cast("string")
    kind = (
        F.when(has("tag_place").isin(*SETTLEMENTS), has("tag_place"))
        .when(has("tag_natural").isin("peak", "volcano", "saddle"), has("tag_natural"))
        .when(has("tag_mountain_pass") == "yes", "mountain_pass")
    )
    people = F.when(F.col("kind").isin(*SETTLEMENTS), parse_population(has("tag_population")))
    return (
        features.withColumn("kind", kind).where(F.col("kind").isNotNull() & (F.coalesce(F.col("name"), F.lit("")) != ""))
        .withColumn("population", F.when(people > 0, people)).withColumn("ele", parse_elevation(has("tag_ele")))
        .withColumn("notable", F.coalesce(has("tag_wikidata"), F.lit("")) != "")
    )


def place_rank(places: DataFrame) -> DataFrame:
    people = F.least(F.floor(F.coalesce(F.col("population"), F.lit(0)) / 1000), F.lit(40))
    return places.withColumn("rank", (lookup(F.col("kind"), PLACE_RANKS) + people).cast("bigint"))


def walkable_filter(ways: DataFrame) -> DataFrame:
    return ways.where(F.col("kind").isin(*WALKABLE) & ~F.coalesce(F.col("access"), F.lit("")).isin("private", "no"))


def notability_filter(peaks: DataFrame, zoom: int) -> DataFrame:
    """Peaks worth drawing at a zoom: prominent enough, or documented, or listed."""
    step = 600 if zoom < 9 else 300 if zoom < 11 else 120 if zoom < 13 else 30 if zoom < 15 else -1
    known = F.lit(zoom >= 9) & F.col("tag_wikidata").isNotNull()
    return peaks.where((F.coalesce(F.col("prom"), F.lit(-1.0)) >= step) | known | list_membership(F.col("lists"), "munro"))


def mercator_guard(points: DataFrame, lat: str = "lat") -> tuple[DataFrame, DataFrame]:
    """Points that Web Mercator can show, and those beyond it."""
    beyond = F.abs(F.col(lat)) > MAX_LATITUDE - 0.001
    return points.where(~beyond), points.where(beyond)


def catalog_select(regions: DataFrame, flag: str | None = None, pattern: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """Regions by flag, id pattern or id list; an unknown id raises."""
    out = regions
    if ids is not None:
        wanted = regions.sparkSession.createDataFrame([(i,) for i in ids], "region_id string")
        unknown = wanted.join(regions, "region_id", "left_anti").limit(1).collect()
        if unknown:
            raise ValueError(f"unknown region {unknown[0][0]}")
        out = out.join(F.broadcast(wanted), "region_id", "left_semi")
    if flag:
        out = out.where(F.col(flag))
    return out.where(F.col("region_id").rlike(pattern)) if pattern else out
