"""Queries of section 2.4."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempotrail.operators import joins as op
from tempotrail.plans.base import query
from tempotrail.plans.proxy import Model

SOURCE = "CASE WHEN id % 3 = 0 THEN 'media' ELSE 'list' END"


@query("jn_result_dims", f"SELECT id, name, nationality, {SOURCE} AS source FROM results")
def jn_result_dims(m: Model) -> DataFrame:
    sources = m.spark.createDataFrame([(0, "media"), (1, "list")], "source_id int, source string")
    rows = m.results.drop("name", "sex", "nationality", "club").withColumn("source_id", (F.col("id") % 3 != 0).cast("int"))
    return op.with_dimensions(rows, m.athletes, sources).select("id", "name", "nationality", "source")


@query("jn_split_4way", f"SELECT s.result_id, c.name AS checkpoint, r.status, CASE WHEN r.id % 3 = 0 THEN 'media' ELSE 'list' END AS source, s.elapsed_seconds FROM splits s JOIN checkpoints c USING (race_id, checkpoint_key) JOIN results r ON r.id = s.result_id")
def jn_split_4way(m: Model) -> DataFrame:
    sources = m.spark.createDataFrame([(0, "media"), (1, "list")], "source_id int, source string")
    r = m.results.select(F.col("id").alias("result_id"), "status", (F.col("id") % 3 != 0).cast("int").alias("source_id"))
    c = m.checkpoints.select("race_id", "checkpoint_key", F.col("name").alias("checkpoint"))
    return m.splits.join(c, ["race_id", "checkpoint_key"]).join(r, "result_id").join(sources, "source_id").select("result_id", "checkpoint", "status", "source", "elapsed_seconds")


@query("jn_collision", """SELECT r.race_id, r.athlete_id, r.id, count(s.sequence_no) AS splits FROM results r LEFT JOIN splits s ON s.result_id = r.id
 WHERE EXISTS (SELECT 1 FROM results x WHERE x.race_id = r.race_id AND x.athlete_id = r.athlete_id AND x.id <> r.id) GROUP BY 1, 2, 3""")  # fmt: skip
def jn_collision(m: Model) -> DataFrame:
    from tempotrail.operators.identity import shared_race

    s = m.splits.groupBy(F.col("result_id").alias("id")).agg(F.count("*").alias("splits"))
    return shared_race(m.results).join(s, "id", "left").select("race_id", "athlete_id", "id", F.coalesce("splits", F.lit(0)).alias("splits"))


@query("jn_cross_race", "SELECT result_id, race_id, race_id + CASE WHEN result_id % 50 = 0 THEN 1 ELSE 0 END AS checkpoint_race FROM splits WHERE result_id % 50 = 0")
def jn_cross_race(m: Model) -> DataFrame:
    other = F.when(F.col("result_id") % 50 == 0, F.col("race_id") + 1).otherwise(F.col("race_id"))
    s = m.splits.withColumn("checkpoint_id", other * 10 + F.col("sequence_no"))
    races = m.races.select("race_id").unionByName(m.races.select((F.col("race_id") + 1).alias("race_id"))).distinct()
    c = races.select("race_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("n")).select("race_id", (F.col("race_id") * 10 + F.col("n")).alias("checkpoint_id"))
    return op.foreign_checkpoints(s, c).select("result_id", "race_id", "checkpoint_race")


@query("jn_not_in", "SELECT id FROM results WHERE id NOT IN (SELECT id FROM results WHERE status = 'DNS')")
def jn_not_in(m: Model) -> DataFrame:
    return op.without(m.results, m.results.filter("status = 'DNS'").select("id"), "id").select("id")


@query("jn_missing_match", "SELECT id FROM results WHERE id NOT IN (SELECT result_id FROM splits)")
def jn_missing_match(m: Model) -> DataFrame:
    return op.without(m.results, m.splits.select(F.col("result_id").alias("id")), "id").select("id")


@query("jn_index", "SELECT r.id, s.sequence_no, s.elapsed_seconds FROM results r JOIN splits s ON s.result_id = r.id")
def jn_index(m: Model) -> DataFrame:
    return m.splits.withColumnRenamed("result_id", "id").join(m.results.select("id"), "id").orderBy("id", "sequence_no").select("id", "sequence_no", "elapsed_seconds")


ROUTES = [(1, "long", None, 1997, "old"), (2, "long", 1998, None, "new"), (3, "long", None, None, "any")]


@query("jn_asof_route", "SELECT race_key, CASE WHEN family = 'short' THEN 'short' WHEN year <= 1997 THEN 'old' ELSE 'new' END AS route FROM races")
def jn_asof_route(m: Model) -> DataFrame:
    rules = m.spark.createDataFrame(ROUTES, "order int, prefix string, first int, last int, route string")
    return op.routes_for(m.races.select("race_key", "year"), rules, "short").select("race_key", "route")


@query("jn_nearest_anchor", """SELECT p.result_id, p.at, (SELECT max(s.distance_km) FROM splits s WHERE s.result_id = p.result_id AND s.distance_km <= p.at) AS prev_anchor,
 (SELECT min(s.distance_km) FROM splits s WHERE s.result_id = p.result_id AND s.distance_km > p.at) AS next_anchor
 FROM (SELECT id AS result_id, unnest([10.0::DOUBLE, 22.5::DOUBLE, 60.0::DOUBLE]) AS at FROM results) p""")  # fmt: skip
def jn_nearest_anchor(m: Model) -> DataFrame:
    points = m.results.select(F.col("id").alias("result_id"), F.explode(F.array(F.lit(10.0), F.lit(22.5), F.lit(60.0))).alias("at"))
    out = op.around(points, m.splits.withColumnRenamed("distance_km", "anchor"), "result_id")
    return out.select("result_id", "at", "prev_anchor", "next_anchor")


@query("jn_split_by_key", """SELECT r.id AS result_id, coalesce(a.elapsed_seconds, b.elapsed_seconds) AS elapsed_seconds FROM results r
 LEFT JOIN splits a ON a.result_id = r.id AND a.checkpoint_key = CASE WHEN r.id % 2 = 0 THEN 'c3' ELSE 'gone' END LEFT JOIN splits b ON b.result_id = r.id AND b.sequence_no = 3""")  # fmt: skip
def jn_split_by_key(m: Model) -> DataFrame:
    wanted = m.results.select(F.col("id").alias("result_id"), F.when(F.col("id") % 2 == 0, "c3").otherwise("gone").alias("checkpoint_key"), F.lit("Control 3").alias("name"))
    s = m.splits.withColumn("name", F.concat(F.lit("Control "), "sequence_no"))
    return op.by_key_or_name(wanted, s).select("result_id", "elapsed_seconds")


@query("jn_alias", """SELECT p_partkey, CASE WHEN contains(' ' || lower(p_type) || ' ', ' steel ') THEN 'iron' WHEN contains(' ' || lower(p_type) || ' ', ' promo ') THEN 'offer' WHEN contains(' ' || lower(p_type) || ' ', ' brass ') THEN 'brass' END AS checkpoint_key FROM part""")
def jn_alias(m: Model) -> DataFrame:
    texts = m.table("part").select("p_partkey", F.lower("p_type").alias("text"))
    return op.by_alias(texts, [("steel", "iron"), ("promo", "offer"), ("brass", "brass")]).select("p_partkey", "checkpoint_key")
