"""Queries of sections 2.10 and 2.11."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempotrail.functions import maths
from tempotrail.functions import text as tx
from tempotrail.plans.base import query
from tempotrail.plans.proxy import Model
from tempotrail.sources.pages import control_key

C = F.col


def pick(key: Column, values: list[str]) -> Column:
    """values in turn by a number."""
    return F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))


def pick_sql(key: str, values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{key} % {len(values)} + 1]"


def expect(name: str, inputs: list[str], outputs: list, function: Callable[[Column], Column], kind: str = "VARCHAR") -> None:
    """A query of the function on the inputs in turn over all orders, against its expected values."""
    values = ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in outputs)
    body = f"SELECT o_orderkey AS id, {pick_sql('o_orderkey', inputs)} AS input, CAST([{values}][o_orderkey % {len(inputs)} + 1] AS {kind}) AS output FROM orders"

    @query(name, body)
    def run(m: Model) -> DataFrame:
        rows = m.table("orders").select(C("o_orderkey").alias("id"), pick(C("o_orderkey"), inputs).alias("input"))
        return rows.withColumn("output", function(C("input")))


expect("fn_clean_text", ["  a \t b ", "", " ", "x"], ["a b", None, None, "x"], tx.clean)
expect("fn_parse_time", ["10:01:02", "tid 59:30 min", "-", "1:2:3", "7:30:00 (netto)", "99:10"], [36062, 3570, None, None, 27000, None], tx.seconds, "BIGINT")
expect("fn_parse_pace", ["5:47 /km", "4.05", "x", "6,10"], [347, 245, None, 370], tx.pace, "BIGINT")
expect("fn_parse_float", ["12,5 km/h", "-3.25", "none", "7"], [12.5, -3.25, None, 7.0], tx.number, "DOUBLE")
expect("fn_parse_diff", ["+1:30", "-0:10:05", " -2:00", "-"], [90, -605, -120, None], tx.signed_seconds, "BIGINT")
expect("fn_parse_int", ["1 234", "plats 7", "-", "12."], [1234, 7, None, 12], tx.whole, "BIGINT")
expect("fn_parse_seconds", ["36062", "36062000", "PT10H1M2S", "10:01:02", "PT45M", "-5", "999999"], [36062, 36062, 36062, 36062, 2700, None, None], tx.any_seconds, "BIGINT")
expect("fn_optional", ["-", "N/A", " Bo ", "", "Saknas", "Ej angivet"], [None, None, "Bo", None, None, None], tx.optional)
expect("fn_norm_class", ["H 40", "D21", "k35", "M50", "", "Motion"], ["M40", "W21", "W35", "M50", "Okänd", "MOTION"], tx.age_class)
expect("fn_norm_club", ["Sälens IF", "Fjällens Idrottsklubb", "A&B löparklubb", "Team Sweden AB", "Ås friidrottsklubb"], ["SALENS IF", "FJALLENS IK", "A OCH B LOPARKLUBB", "TEAM", "AS FK"], tx.club)
expect("fn_club_city", ["Norr IK", "STOCKHOLM", "Evert", "", "Team Norr", "S7ED"], ["club", "city", "ambiguous-kept-as-club", None, "club", "ambiguous-kept-as-club"], tx.club_or_city)
expect("fn_nat_evidence", ['{"selector_values": {"nationality": "SWE"}}', '{"labeled_values": {"nationality": "NOR"}}', '{"x": 1}', '{"selector_values": {"nationality": "-"}, "published_name_original": "Bo Ek (fin)"}'], ["SWE", "NOR", None, "FIN"], tx.nation_in)
expect("fn_cleancp", ["Mora mål", "Start Sälen ", " Control   5 "], ["Mora", "Start", "Control   5"], tx.control_name)


@query("fn_normalize", "SELECT doc_id, trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents")
def fn_normalize(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", tx.normalised(C("text")).alias("norm"))


@query("fn_norm_underscore", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS norm FROM part")
def fn_norm_underscore(m: Model) -> DataFrame:
    return m.table("part").select("p_partkey", tx.normalised(C("p_type"), "_").alias("norm"))


@query("fn_name_nat", "SELECT athlete_id, CASE WHEN athlete_id % 4 = 1 THEN name || ' (ab)' ELSE name END AS name, CASE WHEN athlete_id % 4 > 1 THEN upper(left(nationality, 3)) END AS nation FROM athletes")
def fn_name_nat(m: Model) -> DataFrame:
    """Names without a suffix, with one that is no nation, and with a nation."""
    a, kind = m.athletes, C("athlete_id") % 4
    text = F.when(kind == 0, C("name")).when(kind == 1, F.concat(C("name"), F.lit(" (ab)"))).otherwise(F.concat(C("name"), F.lit(" ("), F.lower(F.left("nationality", F.lit(3))), F.lit(")")))
    name, nation = tx.name_and_nation(text)
    return a.select("athlete_id", name.alias("name"), nation.alias("nation"))


ALIASES = [("anodized steel", "iron"), ("steel", "steel"), ("standard", "plain"), ("tin", "tin"), ("brushed", "plain")]


@query("fn_checkpoint_key", "SELECT p_partkey, CASE " + " ".join(f"WHEN contains(' ' || regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g') || ' ', ' {a} ') THEN '{k}'" for a, k in ALIASES) + " END AS checkpoint_key FROM part")
def fn_checkpoint_key(m: Model) -> DataFrame:
    return m.table("part").select("p_partkey", control_key(C("p_type"), ALIASES).alias("checkpoint_key"))


expect("fn_control", ["Smågan", "MÅL", "Mora förvarning", "Högsta punkten (kontroll)", "Målning", "", "Sälen start"], ["smagan", "mora", "mora_warning", "high_point", None, None, "start"], control_key)


@query("fn_merge_query", "SELECT page_id, 'https://example.org/list?event=E' || page_id || '&page=2' AS url FROM pages")
def fn_merge_query(m: Model) -> DataFrame:
    base = F.concat(F.lit("https://example.org/list?page=1&event=E"), C("page_id"), F.lit("&lang=sv"))
    return m.table("pages").select("page_id", tx.with_query(base, {"page": "2", "lang": None}).alias("url"))


@query("fn_sha", "SELECT doc_id, sha256(text) AS sha256, left(sha1(text), 16) AS short_id FROM documents")
def fn_sha(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.left(F.sha1("text"), F.lit(16)).alias("short_id"))


@query("fn_initials", "SELECT id, CASE WHEN id % 2 = 0 THEN right(bib, 3) ELSE 'C' END AS mark FROM results")
def fn_initials(m: Model) -> DataFrame:
    return m.results.select("id", tx.initials(F.when(C("id") % 2 == 0, C("bib")), C("name")).alias("mark"))


@query("fn_fmt_time", "SELECT id, (finish_seconds // 3600) || ':' || lpad((finish_seconds % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((finish_seconds % 60)::VARCHAR, 2, '0') AS clock FROM results WHERE finish_seconds IS NOT NULL")
def fn_fmt_time(m: Model) -> DataFrame:
    return m.results.filter("finish_seconds is not null").select("id", tx.clock(C("finish_seconds")).alias("clock"))


@query("fn_fmt_bin", "SELECT id, (finish_seconds // 3600) || ':' || lpad((finish_seconds % 3600 // 60)::VARCHAR, 2, '0') AS clock FROM results WHERE finish_seconds IS NOT NULL")
def fn_fmt_bin(m: Model) -> DataFrame:
    return m.results.filter("finish_seconds is not null").select("id", tx.hour_minute(C("finish_seconds")).alias("clock"))


@query("fn_fmt_pace", "SELECT id, (t // 60) || ':' || lpad((t % 60)::VARCHAR, 2, '0') || ' /km' AS pace FROM (SELECT id, floor(finish_seconds / distance_km + 0.5)::BIGINT AS t FROM results WHERE finish_seconds > 0)")
def fn_fmt_pace(m: Model) -> DataFrame:
    return m.results.filter("finish_seconds > 0").select("id", tx.pace_text(C("finish_seconds") / C("distance_km")).alias("pace"))


@query("fn_fmt_speed", "SELECT id, (t // 10) || ',' || (t % 10) || ' km/h' AS speed FROM (SELECT id, floor(distance_km * 3600 / finish_seconds * 10 + 0.5)::BIGINT AS t FROM results WHERE finish_seconds > 0)")
def fn_fmt_speed(m: Model) -> DataFrame:
    return m.results.filter("finish_seconds > 0").select("id", tx.speed_text(C("distance_km") * 3600 / C("finish_seconds")).alias("speed"))


@query("fn_speed_pace", "SELECT id, CASE WHEN finish_seconds > 0 THEN 3600.0::DOUBLE / (finish_seconds / distance_km) END AS speed, CASE WHEN finish_seconds > 0 THEN 3600.0::DOUBLE / (3600.0::DOUBLE / (finish_seconds / distance_km)) END AS pace FROM results")
def fn_speed_pace(m: Model) -> DataFrame:
    pace = C("finish_seconds") / C("distance_km")
    return m.results.select("id", maths.inverse(pace).alias("speed"), maths.inverse(maths.inverse(pace)).alias("pace"))


@query("fn_whole_pace", "SELECT id, finish_seconds / distance_km AS pace FROM results")
def fn_whole_pace(m: Model) -> DataFrame:
    return m.results.select("id", F.try_divide("finish_seconds", "distance_km").alias("pace"))


@query("fn_pct", "SELECT race_id, CASE WHEN count(*) FILTER (sex = 'U') > 0 THEN floor(count(*) FILTER (sex = 'U' AND finish_seconds > 0)::DOUBLE / count(*) FILTER (sex = 'U') * 1000 + 0.5) / 10 ELSE 0.0::DOUBLE END AS pct FROM results GROUP BY 1")
def fn_pct(m: Model) -> DataFrame:
    from tempotrail.operators.aggregates import share

    u = C("sex") == "U"
    return m.results.groupBy("race_id").agg(share(F.count_if(u & (C("finish_seconds") > 0)), F.count_if(u)).alias("pct"))


@query("fn_rel_width", "SELECT id, least(100.0::DOUBLE, finish_seconds / 20000 * 100) AS width FROM results WHERE finish_seconds IS NOT NULL")
def fn_rel_width(m: Model) -> DataFrame:
    return m.results.filter("finish_seconds is not null").select("id", maths.relative_width(C("finish_seconds"), F.lit(20000)).alias("width"))


@query("fn_bar_height", "SELECT race_id, CASE WHEN n > 0 THEN least(120.0::DOUBLE, greatest(2.0::DOUBLE, n / 1500 * 120.0::DOUBLE)) ELSE 0.0::DOUBLE END AS height FROM (SELECT race_id, count(*) AS n FROM results GROUP BY 1)")
def fn_bar_height(m: Model) -> DataFrame:
    return m.results.groupBy("race_id").agg(F.count("*").alias("n")).select("race_id", maths.bar_height(C("n"), F.lit(1500), 120.0).alias("height"))


@query("fn_bubble", "SELECT race_id, greatest(6.0::DOUBLE, least(34.0::DOUBLE, 34 * sqrt(n / 1500))) AS radius FROM (SELECT race_id, count(*) AS n FROM results GROUP BY 1)")
def fn_bubble(m: Model) -> DataFrame:
    return m.results.groupBy("race_id").agg(F.count("*").alias("n")).select("race_id", maths.bubble_radius(C("n"), F.lit(1500)).alias("radius"))


EASED = "CASE WHEN t < 0.5 THEN 4 * t * t * t ELSE 1 - pow(-2 * t + 2, 3) / 2 END"


@query("fn_ease", f"SELECT id, round({EASED}, 9) AS eased FROM (SELECT id, (id % 101) / 100.0::DOUBLE AS t FROM results)")
def fn_ease(m: Model) -> DataFrame:
    return m.results.select("id", F.round(maths.ease((C("id") % 101) / 100.0), 9).alias("eased"))


@query("fn_transition", f"SELECT id, round(10 + 20 * ({EASED}), 9) AS x FROM (SELECT id, (id % 101) / 100.0::DOUBLE AS t FROM results)")
def fn_transition(m: Model) -> DataFrame:
    return m.results.select("id", F.round(maths.between(F.lit(10.0), F.lit(30.0), (C("id") % 101) / 100.0), 9).alias("x"))


@query("fn_timing", "SELECT n, floor(greatest(1, n - 1) * (greatest(1400.0::DOUBLE, least(1800.0::DOUBLE, 21000 / greatest(1, n - 1) - 400)) + 400) + 0.5)::BIGINT AS total FROM (SELECT count(DISTINCT year) AS n FROM races GROUP BY family)")
def fn_timing(m: Model) -> DataFrame:
    return m.races.groupBy("family").agg(F.count_distinct("year").alias("n")).select("n", maths.animation_ms(C("n")).alias("total"))


@query("fn_medal_time", "SELECT id, CASE WHEN family = 'long' THEN CASE sex WHEN 'M' THEN CASE era WHEN 'pre' THEN 34199 ELSE 35999 END WHEN 'F' THEN CASE era WHEN 'pre' THEN 39599 ELSE 41759 END END END::BIGINT AS medal FROM results")
def fn_medal_time(m: Model) -> DataFrame:
    return m.results.select("id", maths.medal_seconds(C("family"), C("era"), C("sex")).alias("medal"))


@query("fn_gap", """SELECT id, 9000 - finish_seconds AS gap, CASE WHEN finish_seconds IS NULL OR d <= 1 THEN 'i nivå' ELSE CASE WHEN d < 3600 THEN (d // 60) || ':' || lpad((d % 60)::VARCHAR, 2, '0') ELSE (d // 3600) || ':' || lpad((d % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((d % 60)::VARCHAR, 2, '0') END
 || CASE WHEN finish_seconds < 9000 THEN ' före' ELSE ' efter' END END AS gap_text FROM (SELECT id, finish_seconds, abs(9000 - finish_seconds) AS d FROM results)""")
def fn_gap(m: Model) -> DataFrame:
    gap = F.lit(9000) - C("finish_seconds")
    return m.results.select("id", gap.alias("gap"), maths.gap_text(gap).alias("gap_text"))


@query("fn_schedule", "SELECT o_orderkey, CASE WHEN o_orderdate::DATE < DATE '1996-06-01' THEN 'before' WHEN o_orderdate::DATE <= DATE '1998-06-30' THEN 'active' ELSE 'after' END AS state FROM orders")
def fn_schedule(m: Model) -> DataFrame:
    return m.table("orders").select("o_orderkey", maths.window_state(F.to_date("o_orderdate"), "1996-06-01", "1998-06-30").alias("state"))


@query("fn_nice_step", "SELECT race_id, (CASE WHEN f <= 1 THEN 1 WHEN f <= 2 THEN 2 WHEN f <= 5 THEN 5 ELSE 10 END * p)::DOUBLE AS step FROM (SELECT race_id, n / 4.0::DOUBLE / p AS f, p FROM (SELECT race_id, n, pow(10, floor(log10(n / 4.0::DOUBLE))) AS p FROM (SELECT race_id, count(*) AS n FROM results GROUP BY 1)))")
def fn_nice_step(m: Model) -> DataFrame:
    return m.results.groupBy("race_id").agg(F.count("*").alias("n")).select("race_id", maths.nice_step(C("n") / 4.0).alias("step"))
