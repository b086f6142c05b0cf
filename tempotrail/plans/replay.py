"""Queries of section 2.13."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempotrail.operators import replay as op
from tempotrail.plans.aggregates import q
from tempotrail.plans.proxy import LAST, Model
from tempotrail.plans.status import classified

#: The race's length as the proxy's last control, so that finishers end where the passages do.
RES = "SELECT id AS result_id, race_id, sex, nclass, CASE WHEN category = 'finished' THEN finish_seconds + 30 END AS finish_seconds, CASE WHEN family = 'short' THEN 46.0::DOUBLE ELSE 92.0::DOUBLE END AS race_km FROM c2"
ANC = """SELECT result_id, 0.0::DOUBLE AS km, 0::BIGINT AS seconds, 'start' AS kind FROM res UNION ALL SELECT s.result_id, s.distance_km, s.elapsed_seconds, 'split' FROM splits s WHERE elapsed_seconds > 0
 UNION ALL SELECT result_id, race_km, finish_seconds, 'finish' FROM res WHERE finish_seconds > 0"""
PRO = f"""SELECT result_id, sequence_no, seconds FROM (SELECT *, count(*) OVER (PARTITION BY result_id) AS n, min(gain) OVER (PARTITION BY result_id) AS least FROM (SELECT *, seconds - coalesce(lag(seconds) OVER (PARTITION BY result_id ORDER BY sequence_no), 0) AS gain FROM (
 SELECT s.result_id, s.sequence_no, s.elapsed_seconds AS seconds FROM splits s JOIN res r USING (result_id) WHERE r.finish_seconds IS NOT NULL AND sequence_no < {LAST} UNION ALL SELECT result_id, {LAST}, finish_seconds FROM res WHERE finish_seconds IS NOT NULL))) WHERE n = {LAST} AND least > 0"""
LIMIT = "CASE sex WHEN 'M' THEN 11400 ELSE 12000 END"


def results(m: Model) -> DataFrame:
    from tempotrail.functions.text import age_class

    c = classified(m)
    return c.select(F.col("id").alias("result_id"), "race_id", "sex", age_class(F.col("age_class")).alias("nclass"), F.when(F.col("category") == "finished", F.col("finish_seconds") + 30).alias("finish_seconds"), F.when(F.col("family") == "short", 46.0).otherwise(92.0).alias("race_km"))


def anchors(m: Model) -> DataFrame:
    return op.anchors(results(m), m.splits)


def profiles(m: Model) -> DataFrame:
    return op.complete_profiles(results(m).filter("finish_seconds is not null"), m.splits, LAST)


def r(name: str, body: str, **views: str):
    return q(name, body, res=RES, anc=ANC, pro=PRO, **views)


@r("rp_anchors", "SELECT * FROM anc")
def rp_anchors(m: Model) -> DataFrame:
    return anchors(m)


@r("rp_anchors_map", "SELECT result_id, exact, CASE WHEN exact >= 3 THEN 'high' WHEN exact >= 1 THEN 'partial' ELSE 'estimate' END AS label, last_seconds FROM (SELECT result_id, count(*) FILTER (kind = 'split') AS exact, max(seconds) AS last_seconds FROM anc GROUP BY 1)")
def rp_anchors_map(m: Model) -> DataFrame:
    rows = op.map_anchors(anchors(m))
    last = rows.groupBy("result_id").agg(F.max("seconds").alias("last_seconds"))
    return op.quality(rows).join(last, "result_id")


@r("rp_segments", "SELECT result_id, sequence_no, segment_seconds AS seconds, distance_km / sequence_no AS km, segment_seconds / (distance_km / sequence_no) AS pace FROM splits")
def rp_segments(m: Model) -> DataFrame:
    return op.segments(m.placed_splits).select("result_id", "sequence_no", "seconds", "km", "pace")


WANT = "SELECT result_id, unnest([15.0::DOUBLE, 30.0::DOUBLE]) AS at_km, unnest([2000.0::DOUBLE, 7000.0::DOUBLE]) AS at_s FROM res"
NEXT = """SELECT w.result_id, w.{at}, round(CASE WHEN b.{x} IS NULL OR a.{x} = w.{at} THEN a.{y} ELSE a.{y} + (b.{y} - a.{y}) * (w.{at} - a.{x}) / (b.{x} - a.{x}) END, 6) AS {y} FROM want w LEFT JOIN LATERAL (SELECT * FROM anc z WHERE z.result_id = w.result_id AND z.{x} <= w.{at} ORDER BY z.{x} DESC LIMIT 1) a ON true
 LEFT JOIN LATERAL (SELECT * FROM anc z WHERE z.result_id = w.result_id AND z.{x} > w.{at} ORDER BY z.{x} LIMIT 1) b ON true"""


def wanted(m: Model, values: list[float]) -> DataFrame:
    return results(m).select("result_id", F.explode(F.array(*map(F.lit, values))).alias("at"))


@r("rp_time_at", NEXT.format(at="at_km", x="km", y="seconds"), want=WANT)
def rp_time_at(m: Model) -> DataFrame:
    return op.time_at(wanted(m, [15.0, 30.0]), anchors(m)).select("result_id", F.col("at").alias("at_km"), F.round("seconds", 6).alias("seconds"))


@r("rp_dist_at", NEXT.format(at="at_s", x="seconds", y="km"), want=WANT)
def rp_dist_at(m: Model) -> DataFrame:
    return op.distance_at(wanted(m, [2000.0, 7000.0]), anchors(m)).select("result_id", F.col("at").alias("at_s"), F.round("km", 6).alias("km"))


@r("rp_state", "SELECT w.result_id, (SELECT arg_max(sequence_no, elapsed_seconds) FROM splits s WHERE s.result_id = w.result_id AND elapsed_seconds <= 5000) AS passed, (SELECT arg_min(sequence_no, elapsed_seconds) FROM splits s WHERE s.result_id = w.result_id AND elapsed_seconds > 5000) AS coming FROM res w")
def rp_state(m: Model) -> DataFrame:
    from tempotrail.operators.joins import around

    s = m.splits.select("result_id", F.col("elapsed_seconds").alias("anchor"), "sequence_no")
    out = around(wanted(m, [5000.0]), s, "result_id", values=["sequence_no"])
    return out.select("result_id", F.col("prev_sequence_no").alias("passed"), F.col("next_sequence_no").alias("coming"))


PS = "SELECT *, segment_seconds / (distance_km / sequence_no) AS pace, lag(place_overall) OVER (PARTITION BY result_id ORDER BY sequence_no) - place_overall AS won FROM splits"
INS = """SELECT result_id, kind, no::BIGINT AS sequence_no, v::DOUBLE AS value FROM (
 SELECT result_id, 'fast' AS kind, arg_min(sequence_no, (pace, sequence_no)) AS no, NULL AS v FROM ps GROUP BY 1 UNION ALL
 SELECT result_id, 'tough', t, NULL FROM (SELECT result_id, arg_max(sequence_no, (pace, -sequence_no)) AS t, arg_min(sequence_no, (pace, sequence_no)) AS f FROM ps GROUP BY 1) WHERE t <> f UNION ALL
 SELECT result_id, 'gain', arg_max(sequence_no, (won, -sequence_no)), max(won) FROM ps WHERE won > 0 GROUP BY 1 UNION ALL SELECT result_id, 'loss', arg_min(sequence_no, (won, sequence_no)), min(won) FROM ps WHERE won < 0 GROUP BY 1 UNION ALL
 SELECT result_id, 'strong_finish', max(sequence_no), NULL FROM ps GROUP BY 1 HAVING count(*) >= 3 AND arg_max(pace, sequence_no) < median(pace) UNION ALL
 SELECT result_id, 'even', arg_min(sequence_no, (turn, sequence_no)) FILTER (turn IS NOT NULL), NULL FROM (SELECT *, abs(pace - lag(pace) OVER (PARTITION BY result_id ORDER BY sequence_no)) AS turn FROM ps) GROUP BY 1 HAVING count(*) >= 3)"""


@r("rp_insights", INS, ps=PS)
def rp_insights(m: Model) -> DataFrame:
    return op.insights(op.segments(m.placed_splits))


@r("rp_complete", "SELECT DISTINCT result_id FROM pro")
def rp_complete(m: Model) -> DataFrame:
    return profiles(m).select("result_id").distinct()


MED = "SELECT race_id, sequence_no, floor(median(seconds) + 0.5)::BIGINT AS s, count(*) AS n FROM pro JOIN res USING (result_id) GROUP BY 1, 2 HAVING count(*) >= 5"


@r("rp_median_ref", f"SELECT race_id, sequence_no, (greatest(max(s - sequence_no) OVER (PARTITION BY race_id ORDER BY sequence_no), 0) + sequence_no)::BIGINT AS seconds, n FROM ({MED})")
def rp_median_ref(m: Model) -> DataFrame:
    return op.median_reference(profiles(m).join(results(m).select("result_id", "race_id"), "result_id"), ["race_id"])


CAND = f"""SELECT *, 1.0::DOUBLE / (1 + away / 600) AS weight FROM (SELECT *, count(*) FILTER (chosen) OVER (PARTITION BY race_id, sex) AS n, row_number() OVER (PARTITION BY race_id, sex, chosen ORDER BY away, finish_seconds, result_id) AS rest FROM (
 SELECT *, row_number() OVER (PARTITION BY race_id, sex, under ORDER BY away, finish_seconds, result_id) <= 40 AS chosen FROM (SELECT result_id, race_id, sex, finish_seconds, medal, abs(finish_seconds - medal) AS away, finish_seconds <= medal AS under
 FROM (SELECT *, {LIMIT} AS medal FROM res) WHERE finish_seconds IS NOT NULL AND sex IN ('M', 'F')))) WHERE chosen OR n + rest <= 40"""


def candidates(m: Model) -> DataFrame:
    rows = results(m).filter("finish_seconds is not null and sex in ('M', 'F')").withColumn("medal", F.when(F.col("sex") == "M", 11_400).otherwise(12_000))
    return op.medal_candidates(rows.drop("nclass", "race_km"), ["race_id", "sex"])


@r("rp_medal_select", "SELECT race_id, sex, result_id, round(weight, 9) AS weight FROM cand", cand=CAND)
def rp_medal_select(m: Model) -> DataFrame:
    return candidates(m).select("race_id", "sex", "result_id", F.round("weight", 9).alias("weight"))


WM = "SELECT {by}, min({v}) AS {v} FROM (SELECT *, sum(weight) OVER (PARTITION BY {by} ORDER BY {v}, weight ROWS UNBOUNDED PRECEDING) AS upto, sum(weight) OVER (PARTITION BY {by}) AS whole FROM {src}) WHERE upto >= whole / 2 GROUP BY {by}"
MEDAL = f"""SELECT race_id, sex, medal::BIGINT AS medal, sequence_no, (greatest(max(s - sequence_no) OVER (PARTITION BY race_id, sex ORDER BY sequence_no), 0) + sequence_no)::BIGINT AS seconds FROM (SELECT *, least(CASE WHEN sequence_no = {LAST} THEN medal ELSE floor(share * medal + 0.5) END, medal - ({LAST} - sequence_no)) AS s FROM (
 {WM.format(by='race_id, sex, medal, sequence_no', v='share', src="(SELECT c.*, p.sequence_no, p.seconds / c.finish_seconds AS share FROM pro p JOIN (SELECT *, count(*) OVER (PARTITION BY race_id, sex) AS size FROM cand) c USING (result_id) WHERE size >= 20)")}))"""


@r("rp_medal_ref", MEDAL, cand=CAND)
def rp_medal_ref(m: Model) -> DataFrame:
    return op.medal_reference(profiles(m), candidates(m), ["race_id", "sex"], LAST).select("race_id", "sex", "medal", "sequence_no", "seconds")


@r("rp_weighted_median", WM.format(by="race_id", v="finish_seconds", src="(SELECT race_id, finish_seconds, (1 + result_id % 7)::BIGINT AS weight FROM res WHERE finish_seconds IS NOT NULL)"))
def rp_weighted_median(m: Model) -> DataFrame:
    rows = results(m).filter("finish_seconds is not null").withColumn("weight", 1 + F.col("result_id") % 7)
    return op.weighted_median(rows, "finish_seconds", "weight", ["race_id"])


@r("rp_map_state", """SELECT race_id, result_id, row_number() OVER (PARTITION BY race_id ORDER BY progress DESC, end_seconds, result_id) AS rank FROM (SELECT r.race_id, r.result_id, coalesce(max(km) FILTER (seconds <= 6000), 0) / any_value(race_km) AS progress, max(seconds) AS end_seconds FROM res r JOIN anc USING (result_id) GROUP BY 1, 2)""")
def rp_map_state(m: Model) -> DataFrame:
    near = anchors(m).groupBy("result_id").agg(F.coalesce(F.max(F.when(F.col("seconds") <= 6000, F.col("km"))), F.lit(0.0)).alias("km"), F.max("seconds").alias("end_seconds"))
    states = results(m).join(near, "result_id").withColumn("progress", F.col("km") / F.col("race_km"))
    return op.standing(states).select("race_id", "result_id", "rank")


@r("rp_events", "SELECT result_id, arg_max(sequence_no, elapsed_seconds) AS sequence_no, max(elapsed_seconds) AS elapsed_seconds FROM splits WHERE elapsed_seconds > 5000 AND elapsed_seconds <= 7400 GROUP BY 1")
def rp_events(m: Model) -> DataFrame:
    return op.passages_between(m.splits, 5000, 7400)


@r("rp_seek_cp", "SELECT race_id, median(elapsed_seconds) AS seconds FROM splits WHERE sequence_no = 4 AND result_id % 3 = 0 GROUP BY 1")
def rp_seek_cp(m: Model) -> DataFrame:
    return m.splits.filter("sequence_no = 4 and result_id % 3 = 0").groupBy("race_id").agg(F.median("elapsed_seconds").alias("seconds"))
