"""Queries of section 2.3."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempotrail.operators import filters as op
from tempotrail.operators.status import evidence
from tempotrail.plans.base import query
from tempotrail.plans.proxy import Model

RACE = 19970


@query("flt_family", "SELECT race_id, family, CASE WHEN race_key LIKE 'short%' THEN 'short' ELSE 'long' END AS app_family FROM races")
def flt_family(m: Model) -> DataFrame:
    key = F.when(F.col("race_id") % 2 == 0, F.concat(F.lit("x"), "race_key")).otherwise(F.col("race_key"))
    return m.races.select("race_id", op.family_of(F.col("race_key")).alias("family"), op.family_of(key, F.when(F.col("race_id") % 2 == 0, F.lit("the 90")).otherwise(F.lit("45"))).alias("app_family"))


@query("flt_family_results", "SELECT id, race_id FROM results WHERE family = 'short'")
def flt_family_results(m: Model) -> DataFrame:
    return m.results.join(m.races.filter(op.family_of(F.col("race_key")) == "short"), "race_id", "left_semi").select("id", "race_id")


@query("flt_conj", f"SELECT id FROM results WHERE race_id = {RACE} AND sex = 'M' AND status = 'FINISHED'")
def flt_conj(m: Model) -> DataFrame:
    return op.matching(m.results, RACE, sex="M", status="FINISHED").select("id")


@query("flt_conj_ignore", "SELECT id FROM results WHERE sex = 'M' AND status = 'FINISHED'")
def flt_conj_ignore(m: Model) -> DataFrame:
    return op.matching(m.results, RACE, sex="M", age_class="H20", status="FINISHED", ignore=("race_id", "age_class")).select("id")


@query("flt_segment_class", "SELECT id, age_class FROM results WHERE age_class = 'W35'")
def flt_segment_class(m: Model) -> DataFrame:
    return op.matching(m.results, age_class="W35").select("id", "age_class")


@query("flt_distinct_class", "SELECT DISTINCT age_class FROM results")
def flt_distinct_class(m: Model) -> DataFrame:
    from tempotrail.functions.text import class_order

    return m.results.select("age_class").distinct().orderBy(*class_order(F.col("age_class")))


@query("flt_sex_toggle", "SELECT id, sex FROM results WHERE sex IN ('F', 'U')")
def flt_sex_toggle(m: Model) -> DataFrame:
    return m.results.filter(F.col("sex").isin("F", "U")).select("id", "sex")


@query("flt_search", "SELECT id, name FROM results WHERE contains(lower(concat_ws(' ', name, club, bib)), '#00000010') ORDER BY NOT starts_with(lower(name), '#00000010'), year DESC, overall_place NULLS LAST, name, id LIMIT 14")
def flt_search(m: Model) -> DataFrame:
    return op.search(m.placed_results, "#00000010").select("id", "name")


@query("flt_search_compare", "SELECT id FROM results WHERE contains(lower(concat_ws(' ', name, club, bib)), 'machinery if') AND id % 10 <> 0 ORDER BY finish_seconds NULLS LAST, id LIMIT 12")
def flt_search_compare(m: Model) -> DataFrame:
    chosen = m.results.filter("id % 10 = 0").select("id")
    return op.search(m.placed_results.join(chosen, "id", "left_anti"), "machinery IF", 12, prefix_first=False).select("id")


@query("flt_search_history", "SELECT athlete_id, name, races FROM (SELECT athlete_id, name, count(*) AS races FROM results GROUP BY 1, 2) WHERE contains(lower(name), '0012') ORDER BY races DESC, athlete_id LIMIT 10")
def flt_search_history(m: Model) -> DataFrame:
    return op.search_histories(m.results.groupBy("athlete_id", "name").agg(F.count("*").alias("races")), "0012")


@query("flt_select_race", "SELECT race_id, year FROM races WHERE family = 'long' ORDER BY year <> 1996, year DESC LIMIT 1")
def flt_select_race(m: Model) -> DataFrame:
    return op.select_race(m.races, "long", 1996).select("race_id", "year")


@query("flt_mixed_guard", "SELECT athlete_id, count(DISTINCT family) > 1 AS mixed FROM results GROUP BY 1")
def flt_mixed_guard(m: Model) -> DataFrame:
    return m.results.groupBy("athlete_id").agg((F.count_distinct("family") > 1).alias("mixed"))


@query("flt_zoom_rect", "SELECT id FROM results WHERE finish_seconds BETWEEN 6000 AND 12000 AND overall_place BETWEEN 1 AND 300")
def flt_zoom_rect(m: Model) -> DataFrame:
    points = m.placed_results.withColumns({"x": F.col("finish_seconds"), "y": F.col("overall_place")})
    return op.zoom(points, (12000, -50), (6000, 300), (0, 90000, 1, 100000)).select("id")


@query("prj_page", f"SELECT id, overall_place FROM results WHERE race_id = {RACE} ORDER BY overall_place NULLS LAST, name, id LIMIT 10 OFFSET 20")
def prj_page(m: Model) -> DataFrame:
    return op.page(op.matching(m.placed_results, RACE), 2).select("id", "overall_place")


@query("prj_hydrate", "SELECT s.result_id, s.checkpoint_key, c.name AS checkpoint_name, c.sequence_no AS checkpoint_no, c.distance_km AS checkpoint_km, 0::BIGINT AS is_estimated FROM splits s LEFT JOIN checkpoints c USING (race_id, checkpoint_key)")
def prj_hydrate(m: Model) -> DataFrame:
    return op.hydrate(m.splits, m.checkpoints).select("result_id", "checkpoint_key", "checkpoint_name", "checkpoint_no", "checkpoint_km", "is_estimated")


@query("prj_sample", """SELECT id, race_id FROM (SELECT id, race_id, row_number() OVER (PARTITION BY race_id ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY race_id) AS n FROM results)
 WHERE n <= 10 OR pos IN (SELECT round_even(i * (n - 1) / 9.0::DOUBLE, 0) FROM range(10) t(i))""")  # fmt: skip
def prj_sample(m: Model) -> DataFrame:
    return op.sample(m.results, ["id"], "race_id").select("id", "race_id")


@query("jn_semi_evidence", "SELECT result_id FROM ev")
def jn_semi_evidence(m: Model) -> DataFrame:
    return evidence(m.splits)
