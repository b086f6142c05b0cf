"""Queries of section 2.12, over tracks made by rule: 5 routes of 200 points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempotrail.operators import geometry as op
from tempotrail.plans.base import query
from tempotrail.plans.proxy import Model

PTS = """SELECT r_regionkey::BIGINT AS route_id, i AS idx, 61 + 0.0005::DOUBLE * i + 0.0001::DOUBLE * ((i * (7 + r_regionkey)) % 13) AS lat, 14 - 0.001::DOUBLE * i + 0.0002::DOUBLE * ((i * (5 + r_regionkey)) % 11) AS lon,
 CASE WHEN i % 67 NOT IN (5, 6, 7) THEN 300 + 2.0::DOUBLE * ((i * (3 + r_regionkey)) % 29) END AS elev FROM region, range(200) t(i)"""
HAV = "2 * 6371.0088::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({b0} - {a0}) / 2), 2) + cos(radians({a0})) * cos(radians({b0})) * pow(sin(radians({b1} - {a1}) / 2), 2))))"
STEP = "CASE WHEN lag(lat) OVER w IS NOT NULL THEN " + HAV.format(a0="lag(lat) OVER w", b0="lat", a1="lag(lon) OVER w", b1="lon") + " END"
MES = f"SELECT *, round(raw_km, 3) AS km FROM (SELECT *, sum(step) OVER (PARTITION BY route_id ORDER BY idx) AS raw_km FROM (SELECT *, coalesce({STEP}, 0) AS step FROM pts WINDOW w AS (PARTITION BY route_id ORDER BY idx)))"
FIL = """SELECT * EXCLUDE (elev, l, r), coalesce(elev, CASE WHEN r.idx - l.idx - 1 <= 8 AND r.raw_km - l.raw_km <= 0.5 AND r.raw_km > l.raw_km THEN l.elev + (r.elev - l.elev) * (raw_km - l.raw_km) / (r.raw_km - l.raw_km) END) AS elev FROM (
 SELECT *, last_value(CASE WHEN elev IS NOT NULL THEN {'idx': idx, 'raw_km': raw_km, 'elev': elev} END IGNORE NULLS) OVER (PARTITION BY route_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l,
 first_value(CASE WHEN elev IS NOT NULL THEN {'idx': idx, 'raw_km': raw_km, 'elev': elev} END IGNORE NULLS) OVER (PARTITION BY route_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM mes)"""
SMO = "SELECT * EXCLUDE (elev), CASE WHEN elev IS NOT NULL THEN median(elev) OVER (PARTITION BY route_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS elev FROM fil"
OFFICIAL = 15.0


def q(name: str, body: str | None):
    return query(name, body, pts=PTS, mes=MES, fil=FIL, smo=SMO)


def points(m: Model) -> DataFrame:
    r, i = F.col("r_regionkey"), F.col("idx")
    rows = m.table("region").select("r_regionkey", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("idx"))
    lat, lon = 61 + 0.0005 * i + 0.0001 * ((i * (7 + r)) % 13), 14 - 0.001 * i + 0.0002 * ((i * (5 + r)) % 11)
    return rows.select(r.alias("route_id"), "idx", lat.alias("lat"), lon.alias("lon"), F.when(~(i % 67).isin(5, 6, 7), 300 + 2.0 * ((i * (3 + r)) % 29)).alias("elev"))


def measured(m: Model) -> DataFrame:
    return op.measured(points(m))


def smooth(m: Model) -> DataFrame:
    return op.smoothed(op.filled(measured(m)))


@q("ge_haversine", f"SELECT route_id, idx, round(step, 6) AS km FROM (SELECT route_id, idx, {STEP} AS step FROM pts WINDOW w AS (PARTITION BY route_id ORDER BY idx)) WHERE idx > 0")
def ge_haversine(m: Model) -> DataFrame:
    return points(m).withColumn("km", F.round(op.step_km(), 6)).filter("idx > 0").select("route_id", "idx", "km")


@q("ge_cumulative", "SELECT route_id, idx, km FROM mes")
def ge_cumulative(m: Model) -> DataFrame:
    return measured(m).select("route_id", "idx", "km")


@q("ge_normalize", f"SELECT route_id, idx, CASE WHEN idx = 199 THEN {OFFICIAL}::DOUBLE ELSE round(km * ({OFFICIAL}::DOUBLE / max(km) OVER (PARTITION BY route_id)), 3) END AS km FROM mes")
def ge_normalize(m: Model) -> DataFrame:
    return op.normalised(measured(m), F.lit(OFFICIAL)).select("route_id", "idx", "km")


@q("ge_profile", "SELECT route_id, idx, km, round(elev, 1) AS elev FROM mes WHERE idx % 4 = 0 OR idx = 199")
def ge_profile(m: Model) -> DataFrame:
    return op.profile(measured(m), 50)


@q("ge_fillgap", "SELECT route_id, idx, round(elev, 6) AS elev FROM fil")
def ge_fillgap(m: Model) -> DataFrame:
    return op.filled(measured(m)).select("route_id", "idx", F.round("elev", 6).alias("elev"))


@q("ge_median5", "SELECT route_id, idx, round(elev, 6) AS elev FROM smo")
def ge_median5(m: Model) -> DataFrame:
    return smooth(m).select("route_id", "idx", F.round("elev", 6).alias("elev"))


@q("ge_ascent", "SELECT route_id, idx, round(sum(greatest(d, 0)) OVER w, 4) AS ascent, round(sum(greatest(-d, 0)) OVER w, 4) AS descent FROM (SELECT *, coalesce(elev - lag(elev) OVER (PARTITION BY route_id ORDER BY idx), 0) AS d FROM smo) WINDOW w AS (PARTITION BY route_id ORDER BY idx)")
def ge_ascent(m: Model) -> DataFrame:
    return op.climbed(smooth(m)).select("route_id", "idx", F.round("ascent", 4).alias("ascent"), F.round("descent", 4).alias("descent"))


@q("ge_grade", """SELECT route_id, idx, round(CASE WHEN elev IS NOT NULL AND l.e IS NOT NULL AND r.e IS NOT NULL AND r.k - l.k >= 0.06 THEN greatest(-35.0::DOUBLE, least(35.0::DOUBLE, (r.e - l.e) / ((r.k - l.k) * 1000) * 100)) END, 4) AS grade FROM (SELECT a.route_id, a.idx, any_value(a.elev) AS elev,
 coalesce(arg_max({'k': b.raw_km, 'e': b.elev}, b.idx) FILTER (b.raw_km <= a.raw_km - 0.03::DOUBLE), arg_min({'k': b.raw_km, 'e': b.elev}, b.idx)) AS l, coalesce(arg_min({'k': b.raw_km, 'e': b.elev}, b.idx) FILTER (b.raw_km >= a.raw_km + 0.03::DOUBLE), arg_max({'k': b.raw_km, 'e': b.elev}, b.idx)) AS r FROM smo a JOIN smo b USING (route_id) GROUP BY 1, 2)""")
def ge_grade(m: Model) -> DataFrame:
    return op.grades(smooth(m)).select("route_id", "idx", F.round("grade", 4).alias("grade"))


@q("ge_rdp", None)
def ge_rdp(m: Model) -> DataFrame:
    return op.simplified(points(m))


@q("ge_gates", "SELECT route_id, unnest(list_filter([CASE WHEN km NOT BETWEEN 16.2 AND 19.8 THEN 'length' END, CASE WHEN known < 0.95 THEN 'elevation_missing' END], lambda x: x IS NOT NULL)) AS code FROM (SELECT route_id, max(raw_km) AS km, count(elev)::DOUBLE / count(*) AS known FROM mes GROUP BY 1)")
def ge_gates(m: Model) -> DataFrame:
    return op.gates(measured(m), F.lit(18.0))


@q("ge_bounds", "SELECT route_id, min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east FROM pts GROUP BY 1")
def ge_bounds(m: Model) -> DataFrame:
    return op.bounds(points(m))


LERP = "CASE WHEN a.km = p.pos THEN a.{c} ELSE a.{c} + (b.{c} - a.{c}) * (p.pos - a.km) / (b.km - a.km) END"
AT = "SELECT p.route_id, p.pos AS \"at\", {values} FROM (SELECT DISTINCT m.route_id, x.pos::DOUBLE AS pos FROM mes m, (VALUES (0.5), (3.25), (7.125)) x(pos)) p JOIN {src} a ON a.route_id = p.route_id AND a.idx = (SELECT max(idx) FROM {src} z WHERE z.route_id = p.route_id AND z.km <= p.pos) JOIN {src} b ON b.route_id = p.route_id AND b.idx = a.idx + 1"


def wanted(m: Model) -> DataFrame:
    return m.table("region").select(F.col("r_regionkey").alias("route_id"), F.explode(F.array(F.lit(0.5), F.lit(3.25), F.lit(7.125))).alias("at"))


@q("ge_point_at", AT.format(values=f"round({LERP.format(c='lat')}, 6) AS lat, round({LERP.format(c='lon')}, 6) AS lon", src="mes"))
def ge_point_at(m: Model) -> DataFrame:
    return op.at_distances(wanted(m), measured(m), "lat", "lon").select("route_id", "at", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@q("ge_terrain_at", AT.format(values=f"round({LERP.format(c='elev')}, 5) AS elev", src="smo"))
def ge_terrain_at(m: Model) -> DataFrame:
    return op.at_distances(wanted(m), smooth(m), "elev").select("route_id", "at", F.round("elev", 5).alias("elev"))


@q("ge_project_cp", AT.format(values=f"round({LERP.format(c='lat')}, 6) AS lat", src="mes"))
def ge_project_cp(m: Model) -> DataFrame:
    from tempotrail.operators.quality import refuse

    controls = wanted(m).withColumn("nth", F.col("at"))
    refuse(op.ascending(controls), "controls don't ascend")
    return op.at_distances(controls, measured(m), "lat").select("route_id", "at", F.round("lat", 6).alias("lat"))


@q("ge_old_model", "SELECT race_id, sequence_no, CASE WHEN sequence_no = 8 THEN 88.0::DOUBLE WHEN sequence_no = 0 THEN 0.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, distance_km - 2), 3) END AS \"at\" FROM checkpoints WHERE race_id % 10 = 0")
def ge_old_model(m: Model) -> DataFrame:
    c = m.checkpoints.filter("race_id % 10 = 0").select("race_id", "sequence_no", F.col("distance_km").alias("at"), (F.col("sequence_no") == 8).alias("is_finish"))
    return op.shifted(c, 90.0, 88.0).select("race_id", "sequence_no", "at")


@q("ge_bezier", "SELECT i AS idx, round((1 - t) * (1 - t) * 61 + 2 * (1 - t) * t * ((61 + 61.1::DOUBLE) / 2 + 0.0022::DOUBLE) + t * t * 61.1::DOUBLE, 6) AS lat, round((1 - t) * (1 - t) * 14 + 2 * (1 - t) * t * ((14 + 13.9::DOUBLE) / 2 + 0.0008::DOUBLE) + t * t * 13.9::DOUBLE, 6) AS lon FROM (SELECT i, i / 80.0::DOUBLE AS t FROM range(81) x(i))")
def ge_bezier(m: Model) -> DataFrame:
    lat, lon = op.bezier((F.lit(61.0), F.lit(14.0)), (F.lit(61.1), F.lit(13.9)), F.col("id") / 80.0)
    return m.spark.range(81).select(F.col("id").alias("idx"), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@q("ge_orient", "SELECT route_id, CASE WHEN route_id % 2 = 0 THEN 199 - idx ELSE idx END AS idx, lat FROM pts")
def ge_orient(m: Model) -> DataFrame:
    p = points(m)
    starts = p.groupBy("route_id").agg(F.when(F.col("route_id") % 2 == 0, F.max_by("lat", "idx")).otherwise(F.min_by("lat", "idx")).alias("start_lat"), F.when(F.col("route_id") % 2 == 0, F.max_by("lon", "idx")).otherwise(F.min_by("lon", "idx")).alias("start_lon"))
    return op.oriented(p, starts).select("route_id", "idx", "lat")


@q("ge_mercator", """SELECT route_id, idx, round((900 - (hx - lx) * s) / 2 + (mx - lx) * s, 3) AS x, round(600 - ((600 - (hy - ly) * s) / 2 + (my - ly) * s), 3) AS y FROM (SELECT *, least(840 / (hx - lx), 540 / (hy - ly)) AS s FROM (SELECT *, min(mx) OVER w AS lx, max(mx) OVER w AS hx, min(my) OVER w AS ly, max(my) OVER w AS hy FROM (SELECT *, radians(lon) AS mx, ln(tan(pi() / 4 + radians(lat) / 2)) AS my FROM pts) WINDOW w AS (PARTITION BY route_id)))""")
def ge_mercator(m: Model) -> DataFrame:
    return op.projected(points(m), 900.0, 600.0, 30.0).select("route_id", "idx", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@q("ge_slice", f"SELECT route_id, km, round(lat, 6) AS lat FROM mes WHERE km > 0.5 AND km < 3.25 UNION ALL SELECT g.route_id, g.\"at\", g.lat FROM ({AT.format(values='round(' + LERP.format(c='lat') + ', 6) AS lat', src='mes')}) g WHERE g.\"at\" < 7")
def ge_slice(m: Model) -> DataFrame:
    return op.sliced(measured(m), 0.5, 3.25).select("route_id", "km", F.round("lat", 6).alias("lat"))
