"""Queries of section 2.5."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempotrail.operators import identity as op
from tempotrail.plans.base import query
from tempotrail.plans.proxy import Model

#: Known athletes and new rows, by rule: names repeat, sexes and years are partly unknown.
KNOWN = "SELECT c_custkey AS athlete_id, 'n' || (c_custkey % 400) AS key, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex, CASE WHEN c_custkey % 3 <> 0 THEN 1950 + c_custkey % 40 END AS birth_year FROM customer WHERE c_custkey % 3 <> 1"
INCOMING = "SELECT o_orderkey AS row_id, 'x' || (o_orderkey % 5000) AS external_id, 'n' || (o_custkey % 450) AS key, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex, CASE WHEN o_orderkey % 2 = 0 THEN 1950 + o_custkey % 40 END AS birth_year FROM orders"
LINKS = "SELECT 'x' || c_custkey AS external_id, c_custkey AS athlete_id FROM customer WHERE c_custkey % 10 = 0"


def known(m: Model) -> DataFrame:
    c = F.col("c_custkey")
    return m.table("customer").filter(c % 3 != 1).select(c.alias("athlete_id"), F.concat(F.lit("n"), (c % 400).cast("string")).alias("key"), F.when(c % 5 == 0, None).when(c % 2 == 0, "M").otherwise("F").alias("sex"), F.when(c % 3 != 0, 1950 + c % 40).alias("birth_year"))


def incoming(m: Model) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return m.table("orders").select(o.alias("row_id"), F.concat(F.lit("x"), (o % 5000).cast("string")).alias("external_id"), F.concat(F.lit("n"), (c % 450).cast("string")).alias("key"), F.when(o % 4 == 0, None).when(c % 2 == 0, "M").otherwise("F").alias("sex"), F.when(o % 2 == 0, 1950 + c % 40).alias("birth_year"))


@query("er_find_athlete", """SELECT r.row_id, coalesce(r.link, r.found, f.nw) AS athlete_id FROM (SELECT i.*, l.athlete_id AS link, (SELECT CASE WHEN count(*) = 1 THEN min(k.athlete_id) END FROM kn k WHERE k.key = i.key AND coalesce(k.sex = i.sex, true) AND coalesce(k.birth_year = i.birth_year, true)) AS found FROM inc i LEFT JOIN li l USING (external_id)) r
 LEFT JOIN (SELECT key, sex, birth_year, 1000000 + row_number() OVER (ORDER BY key, sex NULLS FIRST, birth_year NULLS FIRST) - 1 AS nw FROM (SELECT DISTINCT key, sex, birth_year FROM (SELECT i.*, l.athlete_id AS link, (SELECT CASE WHEN count(*) = 1 THEN min(k.athlete_id) END FROM kn k WHERE k.key = i.key AND coalesce(k.sex = i.sex, true) AND coalesce(k.birth_year = i.birth_year, true)) AS found FROM inc i LEFT JOIN li l USING (external_id)) WHERE link IS NULL AND found IS NULL)) f
 ON f.key = r.key AND f.sex IS NOT DISTINCT FROM r.sex AND f.birth_year IS NOT DISTINCT FROM r.birth_year""", kn=KNOWN, inc=INCOMING, li=LINKS)
def er_find_athlete(m: Model) -> DataFrame:
    c = F.col("c_custkey")
    links = m.table("customer").filter(c % 10 == 0).select(F.concat(F.lit("x"), c.cast("string")).alias("external_id"), c.alias("athlete_id"))
    return op.resolve(incoming(m), known(m), links, 1_000_000)


PAIR = "bib, age_class, status, finish_seconds"


@query("er_same_perf", """SELECT a.id, b.id AS other, NOT (coalesce(ab <> bb, false) OR coalesce(ac <> bc, false) OR coalesce(ast <> bst, false) OR coalesce(af <> bf, false)) AND ((coalesce(ab = bb, false) AND (coalesce(af = bf, false) OR coalesce(ac = bc, false) OR coalesce(ast = bst, false))) OR (coalesce(af = bf, false) AND coalesce(ac = bc, false))) AS same
 FROM (SELECT *, bib AS ab, nullif(age_class, '') AS ac, nullif(nullif(status, ''), 'UNKNOWN') AS ast, finish_seconds AS af FROM p WHERE priority = 0) a JOIN (SELECT *, bib AS bb, nullif(age_class, '') AS bc, nullif(nullif(status, ''), 'UNKNOWN') AS bst, finish_seconds AS bf FROM p WHERE priority = 2) b ON a.race_id = b.race_id AND a.athlete_id = b.athlete_id""",
       p="SELECT *, CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id % 997 AS VARCHAR) END AS bib FROM sources")
def er_same_perf(m: Model) -> DataFrame:
    rows = m.sources.withColumn("bib", F.when(F.col("id") % 3 != 0, (F.col("id") % 997).cast("string")))
    a, b = rows.filter("priority = 0").alias("a"), rows.filter("priority = 2").alias("b")
    return a.join(b, (F.col("a.race_id") == F.col("b.race_id")) & (F.col("a.athlete_id") == F.col("b.athlete_id"))).select("a.id", F.col("b.id").alias("other"), op.same_performance("a", "b").alias("same"))


@query("er_safe_race", "SELECT r.id, NOT EXISTS (SELECT 1 FROM results x WHERE x.race_id = r.race_id AND x.athlete_id = r.athlete_id AND x.id <> r.id) AS safe FROM results r")
def er_safe_race(m: Model) -> DataFrame:
    shared = op.shared_race(m.results).select("id", F.lit(True).alias("shared"))
    return m.results.select("id").join(shared, "id", "left").select("id", F.col("shared").isNull().alias("safe"))


OFFICIAL = "SELECT id AS oid, race_id, CASE WHEN id % 4 = 0 THEN 'x' ELSE bib END AS bib, name AS key, CASE WHEN id % 3 = 0 THEN NULL ELSE finish_seconds END AS finish_seconds, CASE WHEN id % 5 = 0 THEN NULL ELSE overall_place END AS overall_place, age_class FROM results WHERE id % 7 <> 0"


@query("er_match", """SELECT o.oid, a.level, CASE WHEN a.n IS NULL THEN 'unmatched' WHEN a.good = 1 THEN 'matched' WHEN a.n > 1 THEN 'ambiguous' ELSE 'conflict' END AS outcome, CASE WHEN a.good = 1 THEN a.rid END AS result_id FROM off o LEFT JOIN (
 SELECT oid, level, count(*) AS n, count(*) FILTER (NOT cf) AS good, min(rid) FILTER (NOT cf) AS rid FROM (SELECT *, min(level) OVER (PARTITION BY oid) AS best FROM (SELECT o.oid, e.id AS rid, CASE WHEN e.bib = o.bib AND (coalesce(e.finish_seconds = o.finish_seconds, false) OR coalesce(e.overall_place = o.overall_place, false) OR e.age_class = o.age_class) THEN 1 WHEN e.finish_seconds = o.finish_seconds THEN 2 WHEN e.overall_place = o.overall_place AND e.age_class = o.age_class THEN 3 END AS level,
 coalesce(e.bib <> o.bib, false) OR coalesce(e.finish_seconds <> o.finish_seconds, false) OR coalesce(e.overall_place <> o.overall_place, false) AS cf FROM off o JOIN results e ON e.name = o.key AND e.race_id = o.race_id) WHERE level IS NOT NULL) WHERE level = best GROUP BY 1, 2) a USING (oid)""".replace("a.level,", "a.level::BIGINT AS level,"), off=OFFICIAL)
def er_match(m: Model) -> DataFrame:
    i = F.col("id")
    race = m.placed_results
    official = race.filter(i % 7 != 0).select(i.alias("oid"), "race_id", F.when(i % 4 == 0, "x").otherwise(F.col("bib")).alias("bib"), F.col("name").alias("key"), F.when(i % 3 != 0, F.col("finish_seconds")).alias("finish_seconds"), F.when(i % 5 != 0, F.col("overall_place")).alias("overall_place"), "age_class")
    return op.match_levels(race.withColumn("key", F.col("name")), official)


@query("er_collisions", """SELECT g.race_id, g.athlete_id, g.rows, g.differ > 1 OR s.most > 1 AS conflict FROM (SELECT race_id, athlete_id, count(*) AS rows, greatest(count(DISTINCT bib), count(DISTINCT age_class), count(DISTINCT nullif(status, '')), count(DISTINCT finish_seconds), count(DISTINCT overall_place)) AS differ FROM results GROUP BY 1, 2 HAVING count(*) > 1) g
 JOIN (SELECT race_id, athlete_id, max(n) AS most FROM (SELECT race_id, athlete_id, id % 2 AS source, count(*) AS n FROM results GROUP BY 1, 2, 3) GROUP BY 1, 2) s USING (race_id, athlete_id)""")
def er_collisions(m: Model) -> DataFrame:
    return op.collisions(m.placed_results.withColumn("source", F.col("id") % 2))


@query("er_repair", """SELECT id, CASE WHEN nth = 1 THEN athlete_id ELSE 1000000 + row_number() OVER (PARTITION BY nth > 1 ORDER BY race_id, athlete_id, id) - 1 END AS new_athlete_id FROM (SELECT *, row_number() OVER (PARTITION BY race_id, athlete_id ORDER BY CASE WHEN id % 3 = 0 THEN id END NULLS LAST, id) AS nth, count(*) OVER (PARTITION BY race_id, athlete_id) AS n FROM results) WHERE n > 1""")
def er_repair(m: Model) -> DataFrame:
    return op.separated(m.results.withColumn("link_id", F.when(F.col("id") % 3 == 0, F.col("id"))), 1_000_000).select("id", "new_athlete_id")


@query("er_identity_key", "SELECT id, CASE WHEN id % 3 = 0 THEN 'result:' || id ELSE 'athlete:' || athlete_id END AS key FROM results")
def er_identity_key(m: Model) -> DataFrame:
    return m.results.select("id", op.identity_key(F.col("id"), F.when(F.col("id") % 3 != 0, F.col("athlete_id"))).alias("key"))


@query("er_histories", "SELECT athlete_id, string_agg(id::VARCHAR, ',' ORDER BY year, id) AS ids, count(*) AS races FROM results GROUP BY 1")
def er_histories(m: Model) -> DataFrame:
    return op.histories(m.results).select("athlete_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "races")


def _fill(c: str, test: str) -> str:
    return f"coalesce(arg_min({c}, (priority, id)) FILTER ({test}), (SELECT x.{c} FROM sources x WHERE x.race_id = s.race_id AND x.athlete_id = s.athlete_id ORDER BY priority, id LIMIT 1)) AS {c}"


@query("er_merge_sources", f"SELECT race_id, athlete_id, {_fill('status', '''status NOT IN ('', 'UNKNOWN')''')}, {_fill('finish_seconds', 'finish_seconds IS NOT NULL')}, {_fill('age_class', '''age_class <> '' ''')}, count(*) AS sources FROM sources s GROUP BY 1, 2")
def er_merge_sources(m: Model) -> DataFrame:
    return op.merge_by_priority(m.sources, ["race_id", "athlete_id"], ["status", "finish_seconds", "age_class"])


@query("er_merge_splits", "SELECT result_id, sequence_no, coalesce(max(CASE WHEN p = 0 THEN e END), max(CASE WHEN p = 2 THEN e END)) AS elapsed_seconds, count(*) AS sources FROM (SELECT result_id, sequence_no, 0 AS p, CASE WHEN result_id % 3 <> 0 THEN elapsed_seconds END AS e FROM splits UNION ALL SELECT result_id, sequence_no, 2, elapsed_seconds + 7 FROM splits WHERE sequence_no <> 2) GROUP BY 1, 2")
def er_merge_splits(m: Model) -> DataFrame:
    s = m.splits.select("result_id", "sequence_no", F.col("result_id").alias("id"), F.when(F.col("result_id") % 3 != 0, F.col("elapsed_seconds")).alias("elapsed_seconds"), F.lit(0).alias("priority"))
    t = m.splits.filter("sequence_no <> 2").select("result_id", "sequence_no", F.col("result_id").alias("id"), (F.col("elapsed_seconds") + 7).alias("elapsed_seconds"), F.lit(2).alias("priority"))
    return op.merge_by_priority(s.unionByName(t), ["result_id", "sequence_no"], ["elapsed_seconds"], null_only=True)


@query("er_apply_fallback", "SELECT a.id, coalesce(nullif(a.age_class, ''), r.age_class) AS age_class, coalesce(a.finish_seconds, r.finish_seconds) AS finish_seconds FROM sources a JOIN results r USING (id) WHERE priority = 2")
def er_apply_fallback(m: Model) -> DataFrame:
    r = m.results.select("id", F.col("age_class").alias("list_class"), F.col("finish_seconds").alias("list_seconds"))
    return m.sources.filter("priority = 2").join(r, "id").select("id", F.coalesce(op.known(F.col("age_class")), "list_class").alias("age_class"), F.coalesce("finish_seconds", "list_seconds").alias("finish_seconds"))


@query("er_event_score", """SELECT p_size::BIGINT AS p_size, p_partkey, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY score DESC, p_brand DESC, p_partkey DESC) AS nth FROM (SELECT *, CASE WHEN p_partkey % 50 = 0 THEN 10000 ELSE 0 END + CASE WHEN p_name LIKE '%1%' THEN 500 ELSE 0 END + CASE WHEN p_partkey % 7 = 0 THEN 100 ELSE 0 END + CASE WHEN p_type LIKE '%STEEL%' THEN 50 ELSE 0 END - CASE WHEN p_partkey % 3 = 0 THEN 25 ELSE 0 END AS score FROM part) WHERE p_brand NOT LIKE '%5') WHERE nth = 1""")
def er_event_score(m: Model) -> DataFrame:
    k = F.col("p_partkey")
    rows = m.table("part").filter(~F.col("p_brand").endswith("5"))
    return op.best_event(rows, {"verified": k % 50 == 0, "pattern": F.col("p_name").contains("1"), "year": k % 7 == 0, "word": F.col("p_type").contains("STEEL"), "legacy": k % 3 == 0}, ["p_size"], [F.col("p_brand"), k]).select("p_size", "p_partkey", "score")
