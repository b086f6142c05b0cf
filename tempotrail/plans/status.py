"""Queries of section 2.6."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempotrail.operators import status as op
from tempotrail.plans.base import query
from tempotrail.plans.proxy import Model

SUMMARY = """count(*)::BIGINT AS total, count(*) FILTER (category IN ('finished', 'dnf', 'dsq')) AS starters, count(*) FILTER (category = 'finished') AS finishers, count(*) FILTER (category = 'dnf') AS dnf,
 count(*) FILTER (category = 'dns') AS dns, count(*) FILTER (category = 'dsq') AS dsq, count(*) FILTER (category = 'unknown') AS unknown, count(*) FILTER (derived) AS derived_dnf,
 count(*) FILTER (contradictory_finish OR contradictory_dns) AS contradictions,
 CASE WHEN count(*) FILTER (category IN ('finished', 'dnf', 'dsq')) > 0 THEN floor(count(*) FILTER (category = 'finished')::DOUBLE / count(*) FILTER (category IN ('finished', 'dnf', 'dsq')) * 1000 + 0.5) / 10 END AS rate"""


def classified(m: Model) -> DataFrame:
    return op.classify(m.evidenced)


@query("st_classify", "SELECT id, category, derived, has_split, coalesce(contradictory_finish, false) AS contradictory_finish, contradictory_dns FROM cls")
def st_classify(m: Model) -> DataFrame:
    return classified(m).select("id", "category", "derived", "has_split", "contradictory_finish", "contradictory_dns")


@query("st_summary", f"SELECT race_id, sex, {SUMMARY} FROM cls GROUP BY race_id, sex")
def st_summary(m: Model) -> DataFrame:
    return op.summarize(classified(m), "race_id", "sex")


WORDS = "SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN ' Finished ' WHEN 1 THEN 'Brutit' WHEN 2 THEN 'Ej start' WHEN 3 THEN 'DSQ' WHEN 4 THEN 'Startat' WHEN 5 THEN '' WHEN 6 THEN 'Pausad' ELSE 'did not finish' END AS word FROM orders"


def words(m: Model) -> DataFrame:
    i = F.col("o_orderkey") % 8
    out = F.lit("did not finish")
    for n, word in enumerate((" Finished ", "Brutit", "Ej start", "DSQ", "Startat", "", "Pausad")):
        out = F.when(i == n, word).otherwise(out)
    return m.table("orders").select(F.col("o_orderkey").alias("id"), out.alias("word"))


@query("st_norm_mika", "SELECT id, CASE trim(word) WHEN 'Finished' THEN 'FINISHED' WHEN 'Brutit' THEN 'DNF' WHEN 'did not finish' THEN 'DNF' WHEN 'Ej start' THEN 'DNS' WHEN 'DSQ' THEN 'DSQ' WHEN 'Pausad' THEN 'PAUSAD' WHEN 'Startat' THEN 'UNKNOWN' END AS word FROM w", w=WORDS)
def st_norm_mika(m: Model) -> DataFrame:
    return words(m).select("id", op.imported_word(F.col("word")).alias("word"))


@query("st_norm_vasanerd", """SELECT w.id, CASE WHEN finish_seconds IS NOT NULL OR word = ' Finished ' THEN 'FINISHED' WHEN word = 'DSQ' THEN 'DSQ'
 WHEN word IN ('Brutit', 'did not finish', 'Startat') OR has_split THEN 'DNF' WHEN word = '' THEN 'UNKNOWN' ELSE upper(word) END AS word FROM w JOIN cls ON cls.id = w.id""", w=WORDS)  # fmt: skip
def st_norm_vasanerd(m: Model) -> DataFrame:
    return words(m).join(classified(m).select("id", "finish_seconds", "has_split"), "id").select("id", op.feed_word(F.col("word"), F.col("finish_seconds"), F.col("has_split")).alias("word"))


@query("st_sex", "SELECT athlete_id, CASE left(nationality, 1) WHEN 'M' THEN 'M' WHEN 'H' THEN 'M' WHEN 'F' THEN 'F' WHEN 'W' THEN 'F' WHEN 'K' THEN 'F' WHEN 'D' THEN 'F' ELSE 'U' END AS sex FROM athletes")
def st_sex(m: Model) -> DataFrame:
    return m.athletes.select("athlete_id", op.sex(F.substring("nationality", 1, 1)).alias("sex"))


@query("st_sex_python", "SELECT id, CASE WHEN id % 3 = 0 AND sex IN ('M', 'F') THEN sex WHEN left(age_class, 1) IN ('M', 'H') THEN 'M' ELSE 'F' END AS sex FROM results")
def st_sex_python(m: Model) -> DataFrame:
    return m.results.select("id", op.sex_of(F.when(F.col("id") % 3 == 0, F.col("sex")), F.col("age_class")).alias("sex"))


@query("st_sex_replay", "SELECT athlete_id, CASE sex WHEN 'U' THEN NULL ELSE sex END AS sex FROM athletes")
def st_sex_replay(m: Model) -> DataFrame:
    return m.athletes.select("athlete_id", op.sex_category(F.when(F.col("sex") == "M", "man").when(F.col("sex") == "F", "kvinna")).alias("sex"))
