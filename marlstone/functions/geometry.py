"""Geometry as columns: points are (x, y) structs, rings are arrays of points, and WKT is read and written as text.

All functions are built from array expressions, so they stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Query

#: Mean radius in metres of the sphere used for distances.
EARTH = 6371008.8


def point(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x") if not isinstance(x, Column) else x.cast("double").alias("x"), F.lit(y).cast("double").alias("y") if not isinstance(y, Column) else y.cast("double").alias("y"))


def from_wkt(wkt: Column) -> Column:
    """Points of a POINT, LINESTRING or (outer ring of a) POLYGON."""
    body = F.regexp_extract(wkt, r"^[A-Za-z ]*\(+([^()]*)\)", 1)
    pair = lambda p: F.split(F.trim(p), r"\s+")
    return F.transform(F.split(body, ","), lambda p: F.struct(F.element_at(pair(p), 1).cast("double").alias("x"), F.element_at(pair(p), 2).cast("double").alias("y")))


def _number(c: Column) -> Column:
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def as_text(p: Column) -> Column:
    return F.concat(F.lit("POINT("), _number(p["x"]), F.lit(" "), _number(p["y"]), F.lit(")"))


def as_geojson(p: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(p["x"], p["y"]).alias("coordinates")))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], F.lit(2)) + F.pow(a["y"] - b["y"], F.lit(2)))


def distance_sphere(a: Column, b: Column) -> Column:
    """Metres along the sphere between two (longitude, latitude) points."""
    la, lb = F.radians(a["y"]), F.radians(b["y"])
    h = F.pow(F.sin((lb - la) / 2), F.lit(2)) + F.cos(la) * F.cos(lb) * F.pow(F.sin(F.radians(b["x"] - a["x"]) / 2), F.lit(2))
    return 2 * EARTH * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _edges(ring: Column) -> Column:
    """Edges (a, b) of a list of points."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _cross(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def contains(ring: Column, p: Column) -> Column:
    """Whether a point lies inside a ring: odd number of edges to its right; on an edge counts as outside."""
    crossed = F.filter(_edges(ring), lambda e: ((e["a"]["y"] > p["y"]) != (e["b"]["y"] > p["y"])) & (p["x"] < (e["b"]["x"] - e["a"]["x"]) * (p["y"] - e["a"]["y"]) / F.when(e["b"]["y"] != e["a"]["y"], e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    on = F.exists(_edges(ring), lambda e: (_cross(e["a"], e["b"], p) == 0) & p["x"].between(F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"])) & p["y"].between(F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"])))
    return (F.size(crossed) % 2 == 1) & ~on


def signed_area(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def length(line: Column) -> Column:
    return F.aggregate(_edges(line), F.lit(0.0), lambda s, e: s + distance(e["a"], e["b"]))


def centroid(ring: Column) -> Column:
    """Of a ring's area."""
    part = lambda c: F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["a"][c] + e["b"][c]) * (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / (6 * signed_area(ring))
    return F.struct(part("x").alias("x"), part("y").alias("y"))


def envelope(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def buffer(p: Column, radius: float, corners: int = 64) -> Column:
    """A polygon of so many corners around a point."""
    return F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda k: F.struct((p["x"] + radius * F.cos(2 * F.pi() * k / corners)).alias("x"), (p["y"] + radius * F.sin(2 * F.pi() * k / corners)).alias("y")))


def segments_meet(a: Column, b: Column) -> Column:
    """Whether two edges cross or touch."""
    turn = lambda p, q, r: F.signum(_cross(p, q, r))
    spread = (turn(a["a"], a["b"], b["a"]) * turn(a["a"], a["b"], b["b"]) <= 0) & (turn(b["a"], b["b"], a["a"]) * turn(b["a"], b["b"], a["b"]) <= 0)
    near = lambda c: (F.greatest(a["a"][c], a["b"][c]) >= F.least(b["a"][c], b["b"][c])) & (F.greatest(b["a"][c], b["b"][c]) >= F.least(a["a"][c], a["b"][c]))
    return spread & near("x") & near("y")


def intersects(a: Column, b: Column) -> Column:
    """Whether the edges of two lines meet."""
    return F.exists(_edges(a), lambda e: F.exists(_edges(b), lambda f: segments_meet(e, f)))


def box_intersection(a: Column, b: Column) -> Column:
    """The common box of two envelopes, NULL if they are apart."""
    x0, y0 = F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"])
    x1, y1 = F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"])
    return F.when((x0 <= x1) & (y0 <= y1), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def is_valid(ring: Column) -> Column:
    """Whether a ring is closed and no two edges that are not neighbours meet."""
    numbered = F.transform(_edges(ring), lambda e, i: F.struct(e.alias("e"), i.alias("i")))
    n = F.size(ring) - 1
    clash = F.exists(numbered, lambda p: F.exists(numbered, lambda q: (q["i"] > p["i"] + 1) & ~((p["i"] == 0) & (q["i"] == n - 1)) & segments_meet(p["e"], q["e"])))
    return (F.element_at(ring, 1) == F.element_at(ring, -1)) & ~clash


def _one(spark: SparkSession, **columns) -> DataFrame:
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items()))


_wkt = lambda t: from_wkt(F.lit(t))
_BOX, _BOX2 = "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))", "POLYGON((5 5, 15 5, 15 15, 5 15, 5 5))"
_BOW = "POLYGON((0 0, 10 10, 10 0, 0 10, 0 0))"
_here = lambda: point(-73.9857, 40.7484)
_there = lambda: point(-73.9442, 40.6782)

_HAVERSINE = "2 * 6371008.8 * asin(sqrt(pow(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2)))"

#: A place for every customer and supplier, on whole and half degrees.
_PLACE = "CAST({key} % 360 - 180 AS DOUBLE) AS x, CAST({key} % 179 - 89 AS DOUBLE) / 2 AS y"


def _places(spark: SparkSession, sf_dir: str, table: str = "customer", key: str = "c_custkey") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(f"{key} AS id", *_PLACE.format(key=key).split(", "))


_CUSTOMERS = f"(SELECT c_custkey AS id, {_PLACE.format(key='c_custkey')} FROM customer)"
_at = lambda: F.struct("x", "y")


def _near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers within three degrees of each nation's place, by a range join on bands of one coordinate."""
    nations = _places(spark, sf_dir, "nation", "n_nationkey").selectExpr("id AS nation_", "x AS x0", "y AS y0", "explode(sequence(CAST(floor((x - 3) / 3) AS INT), CAST(floor((x + 3) / 3) AS INT))) AS band")
    suppliers = _places(spark, sf_dir, "supplier", "s_suppkey").withColumn("band", F.floor(F.col("x") / 3).cast("int"))
    return suppliers.join(nations, "band").filter(distance(_at(), F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"))) <= 3).select("id", "nation_")


def _nearest_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's nearest supplier: the smallest (distance, id) of a group, no sorting of pairs."""
    nations = _places(spark, sf_dir, "nation", "n_nationkey").selectExpr("id AS nation_", "x AS x0", "y AS y0")
    pairs = _places(spark, sf_dir, "supplier", "s_suppkey").crossJoin(F.broadcast(nations))  # 25 nations
    return pairs.groupBy("nation_").agg(F.min(F.struct(distance(_at(), F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"))).alias("d"), "id")).alias("m")).select("nation_", "m.id")


QUERIES = [
    Query("g01_points", lambda s, d: _one(s, t=as_text(point(1, 2.5)), x=point(1, 2.5)["x"], y=_wkt("POINT(3 4)")[0]["y"]), "SELECT 'POINT(1 2.5)' AS t, CAST(1 AS DOUBLE) AS x, CAST(4 AS DOUBLE) AS y"),
    Query("g02_geojson", lambda s, d: _one(s, j=as_geojson(point(1, 2.5))), "SELECT '{\"type\":\"Point\",\"coordinates\":[1.0,2.5]}' AS j"),
    Query("g03_from_wkt", lambda s, d: _one(s, n=F.size(_wkt(_BOX)), last_x=_wkt("LINESTRING(0 0, 3 4)")[1]["x"]), "SELECT 5 AS n, CAST(3 AS DOUBLE) AS last_x"),
    Query("g04_distance", lambda s, d: _places(s, d).select("id", F.round(distance(_at(), point(3, 4)), 6).alias("d")), f"SELECT id, round(sqrt((x - 3) * (x - 3) + (y - 4) * (y - 4)), 6) AS d FROM {_CUSTOMERS}"),
    Query("g05_distance_sphere", lambda s, d: _places(s, d).select("id", F.round(distance_sphere(_at(), _there()), 3).alias("metres")), f"SELECT id, round({_HAVERSINE}, 3) AS metres FROM (SELECT id, x AS x1, y AS y1, CAST(-73.9442 AS DOUBLE) AS x2, CAST(40.6782 AS DOUBLE) AS y2 FROM {_CUSTOMERS})"),
    Query("g06_contains", lambda s, d: _places(s, d).select("id", contains(_wkt(_BOX), _at()).alias("inside")), f"SELECT id, x > 0 AND x < 10 AND y > 0 AND y < 10 AS inside FROM {_CUSTOMERS}"),
    Query("g07_buffer_envelope", lambda s, d: _one(s, close=F.abs(area(buffer(point(0, 0), 1.0)) - 3.14159) < 0.02, x1=envelope(_wkt("LINESTRING(1 2, 7 3, 4 9)"))["x1"], y1=envelope(_wkt("LINESTRING(1 2, 7 3, 4 9)"))["y1"]), "SELECT true AS close, CAST(7 AS DOUBLE) AS x1, CAST(9 AS DOUBLE) AS y1"),
    Query("g08_measures", lambda s, d: _one(s, area_=area(_wkt(_BOX)), length_=length(_wkt("LINESTRING(0 0, 3 4)")), centre=as_text(centroid(_wkt(_BOX)))), "SELECT CAST(100 AS DOUBLE) AS area_, CAST(5 AS DOUBLE) AS length_, 'POINT(5 5)' AS centre"),
    Query("g09_intersections", lambda s, d: _one(s, meet=intersects(_wkt("LINESTRING(0 0, 4 4)"), _wkt("LINESTRING(0 4, 4 0)")), apart=intersects(_wkt("LINESTRING(0 0, 1 1)"), _wkt("LINESTRING(3 0, 4 0)")), x0=box_intersection(envelope(_wkt(_BOX)), envelope(_wkt(_BOX2)))["x0"]), "SELECT true AS meet, false AS apart, CAST(5 AS DOUBLE) AS x0"),
    Query("g10_srid", lambda s, d: _one(s, srid=F.struct(point(1, 2).alias("p"), F.lit(4326).alias("srid"))["srid"]), "SELECT 4326 AS srid"),
    Query("g11_is_valid", lambda s, d: _one(s, box=is_valid(_wkt(_BOX)), bow=is_valid(_wkt(_BOW))), "SELECT true AS box, false AS bow"),
    Query("g12_within_distance", _near_pairs, "SELECT s.id, n.id AS nation_ FROM (SELECT s_suppkey AS id, " + _PLACE.format(key="s_suppkey") + " FROM supplier) s JOIN (SELECT n_nationkey AS id, " + _PLACE.format(key="n_nationkey") + " FROM nation) n ON sqrt((s.x - n.x) * (s.x - n.x) + (s.y - n.y) * (s.y - n.y)) <= 3"),
    Query("g13_nearest", _nearest_supplier, "SELECT nation_, id FROM (SELECT n.id AS nation_, s.id, row_number() OVER (PARTITION BY n.id ORDER BY sqrt((s.x - n.x) * (s.x - n.x) + (s.y - n.y) * (s.y - n.y)), s.id) AS r FROM (SELECT s_suppkey AS id, " + _PLACE.format(key="s_suppkey") + " FROM supplier) s CROSS JOIN (SELECT n_nationkey AS id, " + _PLACE.format(key="n_nationkey") + " FROM nation) n) WHERE r = 1"),
]
