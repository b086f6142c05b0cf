"""Queries of section 2.7."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempotrail.functions.text import age_class, club
from tempotrail.operators import aggregates as op
from tempotrail.operators import status as st
from tempotrail.plans.base import query
from tempotrail.plans.proxy import LAST, MID, Model
from tempotrail.plans.status import SUMMARY, classified

CLS2 = r"SELECT *, regexp_replace(regexp_replace(age_class, '^H([0-9])', 'M\1'), '^[DK]([0-9])', 'W\1') AS nclass, upper(club) AS clubkey FROM cls"
SEG = """SELECT s.*, c.sex, c.nclass, c.clubkey, c.category, c.year, c.family, c.distance_km AS race_km, c.finish_seconds, s.segment_seconds / km AS pace, 3600.0::DOUBLE / (s.segment_seconds / km) AS speed
 FROM (SELECT *, distance_km / sequence_no AS km FROM splits) s JOIN c2 c ON c.id = s.result_id"""
#: Place-based gain from the middle control to the last known one.
GAIN = f"SELECT result_id, max(CASE WHEN sequence_no = {MID} THEN place_overall END) - arg_max(place_overall, sequence_no) AS gain FROM splits GROUP BY 1"
INDEX = """SELECT id, CASE WHEN n = 1 THEN 100.0::DOUBLE ELSE 100.0::DOUBLE * (n - i) / (n - 1) END AS idx FROM (SELECT id, row_number() OVER (PARTITION BY race_id, sex, nclass ORDER BY finish_seconds, id) AS i,
 count(*) OVER (PARTITION BY race_id, sex, nclass) AS n FROM c2 WHERE category = 'finished')"""


def people(m: Model) -> DataFrame:
    return classified(m).withColumns({"nclass": age_class(F.col("age_class")), "clubkey": F.when(F.col("club").isNotNull(), club(F.col("club")))})


def segments(m: Model) -> DataFrame:
    p = people(m).select(F.col("id").alias("result_id"), "sex", "nclass", "clubkey", "category", "year", "family", F.col("distance_km").alias("race_km"), "finish_seconds")
    s = m.splits.withColumn("km", F.col("distance_km") / F.col("sequence_no")).join(p, "result_id")
    s = s.withColumn("pace", op.pace_of(F.col("segment_seconds"), F.col("km")))
    return s.withColumn("speed", op.speed_of(F.col("pace")))


def finished(m: Model) -> DataFrame:
    return people(m).filter("category = 'finished'")


def q(name: str, body: str, **views: str):
    return query(name, body, c2=CLS2, seg=SEG, gain=GAIN, **views)


FT = "CASE WHEN category = 'finished' THEN finish_seconds END"


@q("ag_export_stats", f"""SELECT race_id, count(*) AS n, count(*) FILTER (category = 'finished') AS finishers, round_even(quantile_cont({FT}, 0.1), 0)::BIGINT AS p10, round_even(quantile_cont({FT}, 0.25), 0)::BIGINT AS p25,
 round_even(quantile_cont({FT}, 0.5), 0)::BIGINT AS median, round_even(quantile_cont({FT}, 0.75), 0)::BIGINT AS p75, round_even(quantile_cont({FT}, 0.9), 0)::BIGINT AS p90, count(*) FILTER (status = 'DNF') AS dnf_word FROM c2 GROUP BY 1""")
def ag_export_stats(m: Model) -> DataFrame:
    p = lambda x: F.bround(op.quantile(op.finish_times(), x)).cast("long")
    return people(m).groupBy("race_id").agg(F.count("*").alias("n"), op.finishers().alias("finishers"), p(0.1).alias("p10"), p(0.25).alias("p25"), p(0.5).alias("median"), p(0.75).alias("p75"), p(0.9).alias("p90"), F.count_if(F.col("status") == "DNF").alias("dnf_word"))


@q("ag_kpis", f"SELECT count(*) AS n, count(*) FILTER (category = 'finished') AS finishers, median({FT}) AS median, min({FT})::BIGINT AS fastest, (SELECT id FROM c2 WHERE category = 'finished' ORDER BY finish_seconds, id LIMIT 1) AS winner, floor(count(*) FILTER (category = 'finished')::DOUBLE / count(*) FILTER (category IN ('finished', 'dnf', 'dsq')) * 100 + 0.5)::BIGINT AS rate FROM c2")
def ag_kpis(m: Model) -> DataFrame:
    t = op.finish_times()
    return people(m).agg(F.count("*").alias("n"), op.finishers().alias("finishers"), F.median(t).alias("median"), F.min(t).alias("fastest"), F.min_by("id", F.when(t.isNotNull(), F.struct(t, "id"))).alias("winner"), F.floor(op.finishers() / op.starters() * 100 + 0.5).cast("long").alias("rate"))


@q("ag_quantile", "SELECT race_id, median(finish_seconds) AS median, round(quantile_cont(finish_seconds, 0.37), 6) AS q37 FROM c2 WHERE category = 'finished' GROUP BY 1")
def ag_quantile(m: Model) -> DataFrame:
    return finished(m).groupBy("race_id").agg(F.median("finish_seconds").alias("median"), F.round(op.quantile("finish_seconds", 0.37), 6).alias("q37"))


@q("ag_histogram", "SELECT start, (SELECT count(*) FROM c2 WHERE category = 'finished' AND finish_seconds >= start AND finish_seconds < start + 900) AS n FROM (SELECT unnest(range(min(finish_seconds) // 900 * 900, max(finish_seconds) + 1, 900)) AS start FROM c2 WHERE category = 'finished')")
def ag_histogram(m: Model) -> DataFrame:
    return op.bins(finished(m))


@q("ag_histogram_sex", "SELECT x.sex, b.start, (SELECT count(*) FROM c2 f WHERE f.category = 'finished' AND f.sex = x.sex AND f.finish_seconds // 900 * 900 = b.start) AS n FROM (SELECT DISTINCT sex FROM c2 WHERE category = 'finished') x, (SELECT unnest(range(min(finish_seconds) // 900 * 900, max(finish_seconds) + 1, 900)) AS start FROM c2 WHERE category = 'finished') b")
def ag_histogram_sex(m: Model) -> DataFrame:
    return op.bins(finished(m), "sex")


@q("ag_segment_median", "SELECT race_id, sequence_no, median(pace) AS median, round(quantile_cont(pace, 0.25), 6) AS p25, round(quantile_cont(pace, 0.75), 6) AS p75, count(*) AS n FROM seg GROUP BY 1, 2")
def ag_segment_median(m: Model) -> DataFrame:
    return segments(m).groupBy("race_id", "sequence_no").agg(F.median("pace").alias("median"), F.round(op.quantile("pace", 0.25), 6).alias("p25"), F.round(op.quantile("pace", 0.75), 6).alias("p75"), F.count("pace").alias("n"))


@q("ag_segment_sex", "SELECT sequence_no, sex, median(pace) AS median, count(*) AS n FROM seg WHERE family = 'long' GROUP BY 1, 2")
def ag_segment_sex(m: Model) -> DataFrame:
    return segments(m).filter("family = 'long'").groupBy("sequence_no", "sex").agg(F.median("pace").alias("median"), F.count("pace").alias("n"))


@q("ag_pace_curve", "SELECT sequence_no, sex, median(speed) AS kmh, count(*) AS n FROM seg WHERE speed > 0 AND speed <= 30 GROUP BY 1, 2")
def ag_pace_curve(m: Model) -> DataFrame:
    return segments(m).filter((F.col("speed") > 0) & (F.col("speed") <= op.MOST_KMH)).groupBy("sequence_no", "sex").agg(F.median("speed").alias("kmh"), F.count("*").alias("n"))


SPEED = "sum(km) * 3600.0::DOUBLE / sum(segment_seconds)"
WHOLE = "sum(distance_km) * 3600.0::DOUBLE / sum(finish_seconds)"


def _samples(m: Model) -> DataFrame:
    return segments(m).withColumn("seconds", F.col("segment_seconds"))


def _wholes(m: Model) -> DataFrame:
    return finished(m).withColumns({"km": F.col("distance_km"), "seconds": F.col("finish_seconds")})


@q("ag_speed_ratio", f"SELECT race_id, sequence_no, count(*) AS n, CASE WHEN count(*) >= 2 THEN {SPEED} END AS kmh FROM seg WHERE speed <= 30 GROUP BY 1, 2")
def ag_speed_ratio(m: Model) -> DataFrame:
    return op.group_speed(_samples(m), "race_id", "sequence_no")


@q("ag_speed_index", f"SELECT sequence_no, 100 * {SPEED} / (SELECT {SPEED} FROM seg WHERE speed <= 30) AS idx FROM seg WHERE speed <= 30 GROUP BY 1")
def ag_speed_index(m: Model) -> DataFrame:
    whole = op.group_speed(_samples(m)).select(F.col("kmh").alias("all"))
    return op.group_speed(_samples(m), "sequence_no").join(F.broadcast(whole), how="cross").select("sequence_no", op.index(F.col("kmh"), F.col("all")).alias("idx"))


RETENTION = f"""SELECT a.sex, a.sequence_no, 100 * a.v / b.v AS idx FROM (SELECT sex, sequence_no, {SPEED} AS v FROM seg WHERE category = 'finished' AND speed <= 30 GROUP BY 1, 2 HAVING count(*) > 1) a
 JOIN (SELECT sex, {WHOLE} AS v FROM c2 WHERE category = 'finished' AND distance_km * 3600.0::DOUBLE / finish_seconds <= 30 GROUP BY 1 HAVING count(*) > 1) b USING (sex)"""


def _retention(m: Model) -> DataFrame:
    part = op.group_speed(_samples(m).filter("category = 'finished'"), "sex", "sequence_no")
    whole = op.group_speed(_wholes(m), "sex").select("sex", F.col("kmh").alias("whole"))
    return part.join(whole, "sex").select("sex", "sequence_no", op.index(F.col("kmh"), F.col("whole")).alias("idx")).filter("idx is not null")


@q("ag_retention", RETENTION)
def ag_retention(m: Model) -> DataFrame:
    return _retention(m)


@q("ag_closing_retention", f"SELECT sex, idx FROM ({RETENTION}) WHERE sequence_no = {LAST}")
def ag_closing_retention(m: Model) -> DataFrame:
    return _retention(m).filter(F.col("sequence_no") == LAST).select("sex", "idx")


@q("ag_gender_kpis", f"""SELECT sex, count(*) FILTER (category IN ('finished', 'dnf', 'dsq')) AS starters, floor(count(*) FILTER (category = 'finished')::DOUBLE / count(*) FILTER (category IN ('finished', 'dnf', 'dsq')) * 1000 + 0.5) / 10 AS finish_pct,
 median({FT}) AS median, floor(count(*) FILTER (category = 'dnf')::DOUBLE / count(*) FILTER (category IN ('finished', 'dnf', 'dsq')) * 1000 + 0.5) / 10 AS dnf_pct FROM c2 GROUP BY 1""")
def ag_gender_kpis(m: Model) -> DataFrame:
    return people(m).groupBy("sex").agg(op.starters().alias("starters"), op.share(op.finishers(), op.starters()).alias("finish_pct"), F.median(op.finish_times()).alias("median"), op.share(F.count_if(F.col("category") == "dnf"), op.starters()).alias("dnf_pct"))


@q("ag_gender_insights", f"SELECT year, floor(count(*) FILTER (sex = 'F' AND category IN ('finished', 'dnf', 'dsq'))::DOUBLE / count(*) FILTER (category IN ('finished', 'dnf', 'dsq')) * 1000 + 0.5) / 10 AS female_pct, (median({FT}) FILTER (sex = 'F') - median({FT}) FILTER (sex = 'M')) / 60 AS gap_minutes FROM c2 GROUP BY 1")
def ag_gender_insights(m: Model) -> DataFrame:
    of = lambda s: F.median(F.when(F.col("sex") == s, op.finish_times()))
    return people(m).groupBy("year").agg(op.share(F.count_if(st.started() & (F.col("sex") == "F")), op.starters()).alias("female_pct"), ((of("F") - of("M")) / 60).alias("gap_minutes"))


@q("ag_gender_history", f"SELECT y.year, x.sex, coalesce(a.total, 0) AS total, coalesce(a.starters, 0) AS starters, coalesce(a.finishers, 0) AS finishers, a.rate FROM (SELECT DISTINCT year FROM races) y, (VALUES ('M'), ('F'), ('X')) x(sex) LEFT JOIN (SELECT year, sex, {SUMMARY} FROM c2 WHERE family = 'short' GROUP BY 1, 2) a ON a.year = y.year AND a.sex = x.sex")
def ag_gender_history(m: Model) -> DataFrame:
    every = m.races.select("year").distinct().withColumn("sex", F.explode(F.array(*map(F.lit, "MFX"))))
    return op.with_empty(st.summarize(people(m).filter("family = 'short'"), "year", "sex"), every, ["year", "sex"]).select("year", "sex", "total", "starters", "finishers", "rate")


@q("ag_year_trend", "SELECT year, sex, median(finish_seconds) AS median, count(*) AS finishers FROM c2 WHERE category = 'finished' GROUP BY 1, 2")
def ag_year_trend(m: Model) -> DataFrame:
    return finished(m).groupBy("year", "sex").agg(F.median("finish_seconds").alias("median"), F.count("*").alias("finishers"))


@q("ag_class_stats", f"""SELECT nclass, count(*) FILTER (category IN ('finished', 'dnf', 'dsq')) AS starters, count(*) FILTER (category = 'finished') AS finishers, median({FT}) AS median, round(quantile_cont({FT}, 0.1), 6) AS top10,
 CASE WHEN count(*) FILTER (category IN ('finished', 'dnf', 'dsq')) > 0 THEN floor(count(*) FILTER (category = 'dnf')::DOUBLE / count(*) FILTER (category IN ('finished', 'dnf', 'dsq')) * 1000 + 0.5) / 10 ELSE 0.0::DOUBLE END AS dnf_pct FROM c2 GROUP BY 1""")
def ag_class_stats(m: Model) -> DataFrame:
    t = op.finish_times()
    return people(m).groupBy("nclass").agg(op.starters().alias("starters"), op.finishers().alias("finishers"), F.median(t).alias("median"), F.round(op.quantile(t, 0.1), 6).alias("top10"), op.share(F.count_if(F.col("category") == "dnf"), op.starters()).alias("dnf_pct"))


@q("ag_class_heat", """SELECT nclass, sequence_no, median(speed) AS median, avg(speed) FILTER (i <= (n + 9) // 10) AS top_mean, max(n) AS n FROM (SELECT *, row_number() OVER (PARTITION BY nclass, sequence_no ORDER BY speed DESC) AS i, count(*) OVER (PARTITION BY nclass, sequence_no) AS n FROM seg WHERE speed > 0 AND speed < 30) GROUP BY 1, 2""")
def ag_class_heat(m: Model) -> DataFrame:
    s = segments(m).filter((F.col("speed") > 0) & (F.col("speed") < op.MOST_KMH)).select("nclass", "sequence_no", "speed")
    medians = s.groupBy("nclass", "sequence_no").agg(F.median("speed").alias("median"), F.count("*").alias("n"))
    top = op.fastest_tenth(s, "speed", "nclass", "sequence_no").select("nclass", "sequence_no", F.col("mean").alias("top_mean"))
    return medians.join(top, ["nclass", "sequence_no"])


@q("ag_class_compare", "SELECT nclass, sequence_no, median(speed) AS kmh FROM seg WHERE nclass IN ('M20', 'W40') AND speed > 0 AND speed < 30 GROUP BY 1, 2")
def ag_class_compare(m: Model) -> DataFrame:
    s = segments(m).filter(F.col("nclass").isin("M20", "W40") & (F.col("speed") > 0) & (F.col("speed") < op.MOST_KMH))
    return s.groupBy("nclass", "sequence_no").agg(F.median("speed").alias("kmh"))


@q("ag_class_history", f"SELECT y.year, k.nclass, a.median, coalesce(a.starters, 0) AS starters, coalesce(a.dnf, 0) AS dnf FROM (SELECT DISTINCT year FROM races) y, (SELECT DISTINCT nclass FROM c2) k LEFT JOIN (SELECT year, nclass, median({FT}) AS median, count(*) FILTER (category IN ('finished', 'dnf', 'dsq')) AS starters, count(*) FILTER (category = 'dnf') AS dnf FROM c2 GROUP BY 1, 2) a ON a.year = y.year AND a.nclass = k.nclass")
def ag_class_history(m: Model) -> DataFrame:
    p = people(m)
    every = F.broadcast(m.races.select("year").distinct()).join(p.select("nclass").distinct(), how="cross")
    groups = p.groupBy("year", "nclass").agg(F.median(op.finish_times()).alias("median"), op.starters().alias("starters"), F.count_if(F.col("category") == "dnf").alias("dnf"))
    return op.with_empty(groups, every, ["year", "nclass"])


EVOLUTION = """SELECT year, nclass, (SELECT sex FROM c2 x WHERE x.year = c.year AND x.nclass = c.nclass GROUP BY sex ORDER BY count(*) DESC, sex LIMIT 1) AS gender, count(*) FILTER (category IN ('finished', 'dnf', 'dsq')) AS participants,
 count(*) FILTER (category = 'finished') AS finishers, median(distance_km * 3600.0::DOUBLE / finish_seconds) FILTER (category = 'finished') AS kmh, median(finish_seconds) FILTER (category = 'finished') AS median FROM c2 c GROUP BY 1, 2 HAVING count(*) FILTER (category = 'finished') > 0"""


def evolution(m: Model) -> DataFrame:
    p = people(m)
    gender = op.most_frequent(p, "sex", "year", "nclass").withColumnRenamed("sex", "gender")
    kmh = F.median(F.when(F.col("category") == "finished", F.col("distance_km") * 3600.0 / F.col("finish_seconds")))
    g = p.groupBy("year", "nclass").agg(op.starters().alias("participants"), op.finishers().alias("finishers"), kmh.alias("kmh"), F.median(op.finish_times()).alias("median")).filter("finishers > 0")
    return g.join(gender, ["year", "nclass"])


@q("ag_class_evolution", EVOLUTION)
def ag_class_evolution(m: Model) -> DataFrame:
    return evolution(m)


CLUBS = f"""SELECT clubkey, count(*) FILTER (category IN ('finished', 'dnf', 'dsq')) AS starters, count(*) FILTER (category = 'finished') AS finishers, median({FT}) AS median, median(i.idx) AS idx, median(g.gain) FILTER (category = 'finished') AS gain,
 count(DISTINCT nclass) AS classes, 100.0::DOUBLE - abs(count(*) FILTER (sex = 'M' AND category IN ('finished', 'dnf', 'dsq')) - count(*) FILTER (sex = 'F' AND category IN ('finished', 'dnf', 'dsq'))) * 100.0::DOUBLE / count(*) FILTER (category IN ('finished', 'dnf', 'dsq')) AS balance
 FROM c2 c LEFT JOIN ix i ON i.id = c.id LEFT JOIN gain g ON g.result_id = c.id WHERE clubkey IS NOT NULL GROUP BY 1"""


def clubs(m: Model, *by: str) -> DataFrame:
    from tempotrail.operators.windows import class_scores, closing_gain

    ix = class_scores(finished(m)).select("id", "idx")
    gain = closing_gain(m.placed_splits, MID).select(F.col("result_id").alias("id"), "gain")
    p = people(m).filter("clubkey is not null").join(ix, "id", "left").join(gain, "id", "left")
    of = lambda s: F.count_if(st.started() & (F.col("sex") == s))
    balance = 100.0 - F.abs(of("M") - of("F")) * 100.0 / op.starters()
    return p.groupBy("clubkey", *by).agg(op.starters().alias("starters"), op.finishers().alias("finishers"), F.median(op.finish_times()).alias("median"), F.median("idx").alias("idx"), F.median(F.when(F.col("category") == "finished", F.col("gain"))).alias("gain"), F.count_distinct("nclass").alias("classes"), balance.alias("balance"))


@q("ag_club_stats", CLUBS, ix=INDEX)
def ag_club_stats(m: Model) -> DataFrame:
    return clubs(m)


@q("ag_club_display", "SELECT clubkey, (SELECT club FROM c2 x WHERE x.clubkey = c.clubkey GROUP BY club ORDER BY count(*) DESC, club LIMIT 1) AS club FROM (SELECT DISTINCT clubkey FROM c2 WHERE clubkey IS NOT NULL) c")
def ag_club_display(m: Model) -> DataFrame:
    return op.most_frequent(people(m).filter("clubkey is not null"), "club", "clubkey")


@q("ag_club_improve", "SELECT clubkey, arg_max(v, year) - arg_min(v, year) AS improvement FROM (SELECT clubkey, year, median(idx) AS v FROM c2 JOIN ix USING (id) WHERE clubkey IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1 HAVING count(*) >= 2", ix=INDEX)
def ag_club_improve(m: Model) -> DataFrame:
    from tempotrail.operators.windows import class_scores

    by_year = class_scores(finished(m)).filter("clubkey is not null").groupBy("clubkey", "year").agg(F.median("idx").alias("v"), F.count("*").alias("n")).filter("n >= 3")
    return by_year.groupBy("clubkey").agg((F.max_by("v", "year") - F.min_by("v", "year")).alias("improvement"), F.count("*").alias("years")).filter("years >= 2").select("clubkey", "improvement")


@q("ag_club_dna", f"SELECT clubkey, idx AS speed, least(100.0::DOUBLE, finishers / 20.0::DOUBLE * 100) AS breadth, finishers * 100.0::DOUBLE / starters AS endurance, starters * 100.0::DOUBLE / max(starters) OVER () AS participation FROM ({CLUBS})", ix=INDEX)
def ag_club_dna(m: Model) -> DataFrame:
    top = F.max("starters").over(Window.partitionBy(F.lit(0)))  # a row a club
    return clubs(m).select("clubkey", F.col("idx").alias("speed"), F.least(F.lit(100.0), F.col("finishers") / 20.0 * 100).alias("breadth"), (F.col("finishers") * 100.0 / F.col("starters")).alias("endurance"), (F.col("starters") * 100.0 / top).alias("participation"))


@q("ag_club_history", f"SELECT clubkey, year, count(*) FILTER (category IN ('finished', 'dnf', 'dsq')) AS starters, count(*) FILTER (category = 'finished') AS finishers, median({FT}) AS median, count(*) FILTER (category IN ('dnf', 'dsq')) AS lost FROM c2 WHERE clubkey IS NOT NULL GROUP BY 1, 2")
def ag_club_history(m: Model) -> DataFrame:
    return people(m).filter("clubkey is not null").groupBy("clubkey", "year").agg(op.starters().alias("starters"), op.finishers().alias("finishers"), F.median(op.finish_times()).alias("median"), F.count_if(F.col("category").isin("dnf", "dsq")).alias("lost"))


@q("ag_club_compare", "SELECT clubkey, sequence_no, median(speed) AS kmh, count(*) AS n FROM seg WHERE clubkey IS NOT NULL AND speed <= 30 GROUP BY 1, 2")
def ag_club_compare(m: Model) -> DataFrame:
    return segments(m).filter("clubkey is not null and speed <= 30").groupBy("clubkey", "sequence_no").agg(F.median("speed").alias("kmh"), F.count("*").alias("n"))


@q("ag_club_merge_top", "SELECT id, min(finish_seconds) AS finish_seconds, count(DISTINCT clubkey) AS clubs FROM c2 WHERE category = 'finished' AND clubkey IN ('MACHINERY', 'FURNITURE IF') GROUP BY id ORDER BY finish_seconds, id LIMIT 20")
def ag_club_merge_top(m: Model) -> DataFrame:
    rows = finished(m).filter(F.col("clubkey").isin("MACHINERY", "FURNITURE IF"))
    return rows.groupBy("id").agg(F.min("finish_seconds").alias("finish_seconds"), F.size(F.collect_set("clubkey")).alias("clubs")).orderBy("finish_seconds", "id").limit(20)


def funnel(m: Model) -> DataFrame:
    """Where those who gave up were seen last, and where they would have gone next."""
    dnf = classified(m).filter("category = 'dnf'").select("id", "race_id", "sex")
    last = m.splits.filter("elapsed_seconds > 0").groupBy(F.col("result_id").alias("id")).agg(F.max("sequence_no").alias("last_no"))
    seen = dnf.join(last, "id", "left")
    following = Window.partitionBy("race_id").orderBy("sequence_no")
    names = m.checkpoints.select(F.col("race_id").alias("_race"), F.col("sequence_no").alias("last_no"), F.col("name").alias("from"), F.lead("name").over(following.partitionBy("race_id")).alias("to"))
    out = seen.join(names, (F.col("race_id") == F.col("_race")) & seen["last_no"].eqNullSafe(names["last_no"]), "left").select(seen["sex"], F.coalesce(seen["last_no"], F.lit(999)).alias("place"), "from", "to")
    counts = out.groupBy("sex", "place", "from", "to").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.floor(F.col("n") / F.sum("n").over(Window.partitionBy("sex")) * 1000 + 0.5) / 10)


@q("ag_dnf_funnel", """SELECT sex, place, "from", "to", n, floor(n::DOUBLE / sum(n) OVER (PARTITION BY sex) * 1000 + 0.5) / 10 AS share FROM (SELECT c.sex, coalesce(l.last_no, 999) AS place, f.name AS "from", t.name AS "to", count(*) AS n FROM c2 c
 LEFT JOIN (SELECT result_id, max(sequence_no) AS last_no FROM splits WHERE elapsed_seconds > 0 GROUP BY 1) l ON l.result_id = c.id LEFT JOIN checkpoints f ON f.race_id = c.race_id AND f.sequence_no = l.last_no
 LEFT JOIN checkpoints t ON t.race_id = c.race_id AND t.sequence_no = l.last_no + 1 WHERE c.category = 'dnf' GROUP BY 1, 2, 3, 4)""")
def ag_dnf_funnel(m: Model) -> DataFrame:
    return funnel(m)


@q("ag_field_flow", """SELECT race_id, n AS sequence_no, count(*) FILTER (reached >= n) AS passed FROM (SELECT c.race_id, CASE WHEN category = 'finished' THEN 8 ELSE coalesce(l.last_no, 0) END AS reached, category = 'dnf' AS lost, l.last_no IS NOT NULL AS located FROM c2 c
 LEFT JOIN (SELECT result_id, max(sequence_no) AS last_no FROM splits GROUP BY 1) l ON l.result_id = c.id WHERE category IN ('finished', 'dnf', 'dsq')), range(9) t(n) GROUP BY 1, 2 HAVING count(*) FILTER (lost AND located) >= 0.25 * count(*) FILTER (lost)""")
def ag_field_flow(m: Model) -> DataFrame:
    last = m.splits.groupBy(F.col("result_id").alias("id")).agg(F.max("sequence_no").alias("last_no"))
    rows = classified(m).filter(st.started()).join(last, "id", "left")
    reached = F.when(F.col("category") == "finished", LAST).otherwise(F.coalesce("last_no", F.lit(0)))
    lost = F.col("category") == "dnf"
    counts = rows.groupBy("race_id").agg(*(F.count_if(reached >= i).alias(f"c{i}") for i in range(LAST + 1)), F.count_if(lost).alias("lost"), F.count_if(lost & F.col("last_no").isNotNull()).alias("located"))
    return counts.filter(F.col("located") >= 0.25 * F.col("lost")).select("race_id", F.posexplode(F.array(*(f"c{i}" for i in range(LAST + 1)))).alias("sequence_no", "passed"))


@q("ag_coverage", "SELECT year, count(*) AS results, floor(count(*) FILTER (has_split)::DOUBLE / count(*) * 1000 + 0.5) / 10 AS covered FROM c2 GROUP BY 1")
def ag_coverage(m: Model) -> DataFrame:
    return people(m).groupBy("year").agg(F.count("*").alias("results"), op.share(F.count_if("has_split"), F.count("*")).alias("covered"))


@q("ag_stories", f"""SELECT c.race_id, arg_min(id, (finish_seconds, id)) FILTER (category = 'finished') AS winner, median({FT}) AS median, arg_max(id, (finish_seconds, id)) FILTER (category = 'finished') AS last_finisher,
 max(slow.sequence_no) AS slowest_segment, max(g.gain) AS best_gain FROM c2 c LEFT JOIN (SELECT result_id, arg_min(place_overall, sequence_no) - arg_max(place_overall, sequence_no) AS gain FROM splits GROUP BY 1) g ON g.result_id = c.id
 LEFT JOIN (SELECT race_id, arg_max(sequence_no, (p, -sequence_no)) AS sequence_no FROM (SELECT race_id, sequence_no, median(pace) AS p FROM seg GROUP BY 1, 2) GROUP BY 1) slow ON slow.race_id = c.race_id GROUP BY 1""")
def ag_stories(m: Model) -> DataFrame:
    gain = m.placed_splits.groupBy(F.col("result_id").alias("id")).agg((F.min_by("place_overall", "sequence_no") - F.max_by("place_overall", "sequence_no")).alias("gain"))
    slow = segments(m).groupBy("race_id", "sequence_no").agg(F.median("pace").alias("p")).groupBy("race_id").agg(F.max_by("sequence_no", F.struct("p", -F.col("sequence_no"))).alias("slowest_segment"))
    key = F.when(F.col("category") == "finished", F.struct("finish_seconds", "id"))
    out = people(m).join(gain, "id", "left").groupBy("race_id").agg(F.min_by("id", key).alias("winner"), F.median(op.finish_times()).alias("median"), F.max_by("id", key).alias("last_finisher"), F.max("gain").alias("best_gain"))
    return out.join(slow, "race_id", "left")


@q("ag_percentiles", " UNION ALL ".join(f"SELECT sex, {p}::DOUBLE AS p, round(quantile_cont(finish_seconds, {p}), 6) AS seconds FROM c2 WHERE category = 'finished' GROUP BY 1" for p in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75)))
def ag_percentiles(m: Model) -> DataFrame:
    ps = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75]
    out = finished(m).groupBy("sex").agg(F.percentile("finish_seconds", ps).alias("q"))
    return out.select("sex", F.explode(F.arrays_zip(F.array(*map(F.lit, ps)).alias("p"), "q")).alias("z")).select("sex", F.col("z.p").alias("p"), F.round(F.col("z.q"), 6).alias("seconds"))


@q("ag_dna", f"SELECT race_id, round(quantile_cont({FT}, 0.75) - quantile_cont({FT}, 0.25), 6) AS iqr, median({FT}) FILTER (sex = 'M') AS men, median({FT}) FILTER (sex = 'F') AS women, (SELECT clubkey FROM c2 x WHERE x.race_id = c.race_id AND clubkey IS NOT NULL GROUP BY clubkey ORDER BY count(*) DESC, clubkey LIMIT 1) AS club FROM c2 c GROUP BY 1")
def ag_dna(m: Model) -> DataFrame:
    t = op.finish_times()
    of = lambda s: F.median(F.when(F.col("sex") == s, t))
    p = people(m)
    top = op.most_frequent(p.filter("clubkey is not null"), "clubkey", "race_id").withColumnRenamed("clubkey", "club")
    return p.groupBy("race_id").agg(F.round(op.quantile(t, 0.75) - op.quantile(t, 0.25), 6).alias("iqr"), of("M").alias("men"), of("F").alias("women")).join(top, "race_id", "left")


@q("ag_fingerprint", f"""SELECT family, year, median / avg(median) OVER w AS difficulty, dnf / avg(dnf) OVER w AS dnf, women / avg(women) OVER w AS women, n / avg(n) OVER w AS size FROM (SELECT family, year, median({FT}) AS median,
 count(*) FILTER (category = 'dnf')::DOUBLE / count(*) AS dnf, count(*) FILTER (sex = 'F')::DOUBLE / count(*) AS women, count(*)::DOUBLE AS n FROM c2 GROUP BY 1, 2) WINDOW w AS (PARTITION BY family)""")
def ag_fingerprint(m: Model) -> DataFrame:
    g = people(m).groupBy("family", "year").agg(F.median(op.finish_times()).alias("median"), (F.count_if(F.col("category") == "dnf") / F.count("*")).alias("dnf"), (F.count_if(F.col("sex") == "F") / F.count("*")).alias("women"), F.count("*").cast("double").alias("n"))
    against = lambda c: F.col(c) / F.avg(c).over(Window.partitionBy("family"))
    return g.select("family", "year", against("median").alias("difficulty"), against("dnf").alias("dnf"), against("women").alias("women"), against("n").alias("size"))


@q("ag_target_sim", "SELECT race_id, arg_min(id, (abs(finish_seconds - 9000), id)) AS nearest, count(*) FILTER (finish_seconds <= 9000) AS within, greatest(1, floor(count(*) FILTER (finish_seconds <= 9000)::DOUBLE / count(*) * 100 + 0.5))::BIGINT AS top_pct FROM c2 WHERE category = 'finished' GROUP BY 1")
def ag_target_sim(m: Model) -> DataFrame:
    within = F.count_if(F.col("finish_seconds") <= 9000)
    return finished(m).groupBy("race_id").agg(F.min_by("id", F.struct(F.abs(F.col("finish_seconds") - 9000), "id")).alias("nearest"), within.alias("within"), F.greatest(F.lit(1), F.floor(within / F.count("*") * 100 + 0.5)).cast("long").alias("top_pct"))


@q("ag_import_counts", "SELECT year, status, count(*) AS results, sum(coalesce(n, 0))::BIGINT AS splits FROM results LEFT JOIN (SELECT result_id, count(*) AS n FROM splits GROUP BY 1) s ON s.result_id = id GROUP BY 1, 2")
def ag_import_counts(m: Model) -> DataFrame:
    n = m.splits.groupBy(F.col("result_id").alias("id")).agg(F.count("*").alias("n"))
    return m.results.join(n, "id", "left").groupBy("year", "status").agg(F.count("*").alias("results"), F.sum(F.coalesce("n", F.lit(0))).alias("splits"))


@q("ag_race_quality", """SELECT race_id, count(*) AS results, count(*) FILTER (has_split) AS covered, sum(coalesce(back, 0))::BIGINT AS not_increasing, sum(coalesce(late, 0))::BIGINT AS after_finish FROM c2 c
 LEFT JOIN (SELECT result_id, count(*) FILTER (elapsed_seconds <= p) AS back, count(*) FILTER (elapsed_seconds > f) AS late FROM (SELECT s.*, lag(elapsed_seconds) OVER (PARTITION BY result_id ORDER BY sequence_no) AS p, r.finish_seconds - 60 AS f FROM splits s JOIN results r ON r.id = s.result_id) GROUP BY 1) q ON q.result_id = c.id GROUP BY 1""")
def ag_race_quality(m: Model) -> DataFrame:
    r = m.results.select(F.col("id").alias("result_id"), (F.col("finish_seconds") - 60).alias("f"))
    before = F.lag("elapsed_seconds").over(Window.partitionBy("result_id").orderBy("sequence_no"))
    bad = m.splits.join(r, "result_id").withColumn("p", before).groupBy(F.col("result_id").alias("id")).agg(F.count_if(F.col("elapsed_seconds") <= F.col("p")).alias("back"), F.count_if(F.col("elapsed_seconds") > F.col("f")).alias("late"))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return classified(m).join(bad, "id", "left").groupBy("race_id").agg(F.count("*").alias("results"), F.count_if("has_split").alias("covered"), total("back").alias("not_increasing"), total("late").alias("after_finish"))


@q("ag_digest", "SELECT race_id, sha256(string_agg(d, '' ORDER BY d)) AS digest FROM (SELECT race_id, left(d, 3) || sha256(string_agg(d, '' ORDER BY d)) AS d FROM (SELECT race_id, sha256(concat_ws('|', id, athlete_id, coalesce(status, ''), coalesce(finish_seconds::VARCHAR, ''))) AS d FROM results) GROUP BY 1, left(d, 3)) GROUP BY 1")
def ag_digest(m: Model) -> DataFrame:
    from tempotrail.operators.quality import digest

    return digest(m.results, ["id", "athlete_id", "status", "finish_seconds"], "race_id")


@q("ag_having_dup", "SELECT race_id, athlete_id, count(*) AS n FROM results GROUP BY 1, 2 HAVING count(*) > 1")
def ag_having_dup(m: Model) -> DataFrame:
    return m.results.groupBy("race_id", "athlete_id").agg(F.count("*").alias("n")).filter("n > 1")
