"""Queries of section 2.14."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempotrail.operators import quality as op
from tempotrail.operators.identity import collisions
from tempotrail.plans.aggregates import q
from tempotrail.plans.proxy import Model
from tempotrail.plans.status import classified
from tempotrail.plans.windows import GAPPED, ISSUES, gapped

RULES = "CASE family WHEN 'long' THEN 14400 ELSE 5400 END"


@q("va_rule", "SELECT race_key, CASE family WHEN 'long' THEN 14400 ELSE 5400 END::BIGINT AS least, CASE family WHEN 'long' THEN 86400 ELSE 54000 END::BIGINT AS most FROM races")
def va_rule(m: Model) -> DataFrame:
    return op.rule_for(m.races).select("race_key", "least", "most")


@q("va_issues", f"""SELECT race_id, code, count(*) AS n FROM (SELECT race_id, 'finished_without_time' AS code FROM results WHERE status = 'FINISHED' AND finish_seconds IS NULL UNION ALL SELECT race_id, 'too_fast' FROM results WHERE finish_seconds < {RULES} UNION ALL
 SELECT race_id, 'duplicate' FROM results GROUP BY race_id, athlete_id HAVING count(*) > 1 UNION ALL SELECT race_id, 'backwards' FROM (SELECT *, lag(elapsed_seconds) OVER (PARTITION BY result_id ORDER BY sequence_no) AS p FROM g) WHERE elapsed_seconds < p) GROUP BY 1, 2""", g=GAPPED)
def va_issues(m: Model) -> DataFrame:
    from tempotrail.operators.windows import backwards

    every = op.result_issues(m.results).select("race_id", "code")
    twice = m.results.groupBy("race_id", "athlete_id").count().filter("count > 1").select("race_id", F.lit("duplicate").alias("code"))
    back = backwards(gapped(m)).select("race_id", F.lit("backwards").alias("code"))
    return every.unionByName(twice).unionByName(back).groupBy("race_id", "code").agg(F.count("*").alias("n"))


@q("va_detail", f"SELECT code, severity, count(*) AS n FROM ({ISSUES}) GROUP BY 1, 2", g=GAPPED)
def va_detail(m: Model) -> DataFrame:
    return op.sequence_issues(gapped(m), m.results).groupBy("code", "severity").agg(F.count("*").alias("n"))


@q("va_probe", "SELECT race_id, unnest(list_filter([CASE WHEN n < 1000 THEN 'few_results' END, CASE WHEN finishers = 0 THEN 'no_finisher' END, CASE WHEN named < n THEN 'names_missing' END, CASE WHEN covered < 0.99 THEN 'splits_missing' END], lambda x: x IS NOT NULL)) AS code FROM (SELECT race_id, count(*) AS n, count(*) FILTER (category = 'finished') AS finishers, count(name) AS named, count(*) FILTER (has_split)::DOUBLE / count(*) AS covered FROM c2 GROUP BY 1)")
def va_probe(m: Model) -> DataFrame:
    g = classified(m).groupBy("race_id").agg(F.count("*").alias("n"), F.count_if(F.col("category") == "finished").alias("finishers"), F.count("name").alias("named"), (F.count_if("has_split") / F.count("*")).alias("covered"))
    return op.issues(g, ["race_id"], {"few_results": F.col("n") < 1000, "no_finisher": F.col("finishers") == 0, "names_missing": F.col("named") < F.col("n"), "splits_missing": F.col("covered") < 0.99})


@q("va_history", "SELECT 'changed' AS side, id FROM results WHERE id % 40 = 0 UNION ALL SELECT 'snapshot', id FROM results WHERE id % 40 = 0")
def va_history(m: Model) -> DataFrame:
    snapshot = m.results.select("id", "bib", "status")
    now = snapshot.withColumn("bib", F.when(F.col("id") % 40 == 0, "new").otherwise(F.col("bib")))
    return now.exceptAll(snapshot).select(F.lit("changed").alias("side"), "id").unionByName(snapshot.exceptAll(now).select(F.lit("snapshot").alias("side"), "id"))


@q("va_availability", "SELECT race_id, count(*) BETWEEN 400 AND 1700 AS in_range, count(*) FILTER (category = 'finished') > 0 AS finished, count(*) FILTER (has_split) >= 0.5 * count(*) AS covered FROM c2 GROUP BY 1")
def va_availability(m: Model) -> DataFrame:
    return classified(m).groupBy("race_id").agg(F.count("*").between(400, 1700).alias("in_range"), (F.count_if(F.col("category") == "finished") > 0).alias("finished"), (F.count_if("has_split") >= 0.5 * F.count("*")).alias("covered"))


@q("va_idempotent", """SELECT race_id, coalesce(sum(CASE WHEN a.status IS DISTINCT FROM b.status OR a.finish_seconds IS DISTINCT FROM b.finish_seconds OR a.age_class IS DISTINCT FROM b.age_class THEN 1 ELSE 0 END), 0) = 0 AS same FROM once a FULL JOIN twice b USING (race_id, id) GROUP BY 1""",
   once="SELECT r.race_id, r.id, coalesce(s.status, r.status) AS status, coalesce(s.finish_seconds, r.finish_seconds) AS finish_seconds, coalesce(s.age_class, r.age_class) AS age_class FROM results r FULL JOIN (SELECT * FROM sources WHERE priority = 0) s ON s.race_id = r.race_id AND s.id = r.id",
   twice="SELECT r.race_id, r.id, coalesce(s.status, r.status) AS status, coalesce(s.finish_seconds, r.finish_seconds) AS finish_seconds, coalesce(s.age_class, r.age_class) AS age_class FROM once r FULL JOIN (SELECT * FROM sources WHERE priority = 0) s ON s.race_id = r.race_id AND s.id = r.id")
def va_idempotent(m: Model) -> DataFrame:
    from tempotrail.sources.sinks import upsert

    key, columns = ["race_id", "id"], ["status", "finish_seconds", "age_class"]
    old, new = m.results.select(*key, *columns), m.sources.filter("priority = 0").select(*key, *columns)
    once = upsert(old, new, key, columns)
    twice = upsert(once, new, key, columns)
    a, b = (op.digest(x, [*key, *columns], "race_id").select("race_id", F.col("digest").alias(n)) for x, n in ((once, "a"), (twice, "b")))
    return a.join(b, "race_id").select("race_id", (F.col("a") == F.col("b")).alias("same"))


@q("va_verify", "SELECT (SELECT count(*) FROM results) AS results, (SELECT count(*) FROM splits) AS splits, (SELECT count(*) FROM splits WHERE result_id NOT IN (SELECT id FROM results)) AS orphans, (SELECT count(*) FROM (SELECT result_id, sequence_no FROM splits GROUP BY 1, 2 HAVING count(*) > 1)) AS doubles")
def va_verify(m: Model) -> DataFrame:
    r = m.results.agg(F.count("*").alias("results"))
    s = m.splits.agg(F.count("*").alias("splits"))
    o = op.orphans(m.splits, "result_id", m.results, "id").agg(F.count("*").alias("orphans"))
    d = m.splits.groupBy("result_id", "sequence_no").count().filter("count > 1").agg(F.count("*").alias("doubles"))
    return r.join(s, how="cross").join(o, how="cross").join(d, how="cross")  # four single rows


@q("va_export_gate", "SELECT race_id, count(*) AS groups FROM (SELECT race_id, athlete_id FROM results WHERE athlete_id % 2 = 0 GROUP BY 1, 2 HAVING count(*) = 1) GROUP BY 1")
def va_export_gate(m: Model) -> DataFrame:
    rows = m.placed_results.withColumn("source", F.lit(0))
    alone = rows.filter("athlete_id % 2 = 0").join(collisions(rows).select("race_id", "athlete_id"), ["race_id", "athlete_id"], "left_anti")
    op.refuse(collisions(alone).filter("conflict"), "identities collide")
    return alone.groupBy("race_id").agg(F.count("*").alias("groups"))


@q("va_db", "SELECT 'orders.customer' AS reference, count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lineitem.order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'customer.nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def va_db(m: Model) -> DataFrame:
    checks = [("orders.customer", "orders", "o_custkey", "customer", "c_custkey"), ("lineitem.order", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("customer.nation", "customer", "c_nationkey", "nation", "n_nationkey")]
    parts = [op.orphans(m.table(a), k, m.table(b), p).agg(F.lit(name).alias("reference"), F.count("*").alias("orphans")) for name, a, k, b, p in checks]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
