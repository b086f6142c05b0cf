"""Queries of sections 2.1 and 2.2: readers and writers over texts made from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempotrail.functions.text import clock
from tempotrail.operators.identity import known
from tempotrail.plans.base import query
from tempotrail.plans.geometry import measured, points
from tempotrail.plans.geometry import q as geometry
from tempotrail.plans.proxy import CONTROLS, LAST, Model
from tempotrail.sources import feeds, pages, scratch
from tempotrail.sources import readers as src
from tempotrail.sources import sinks as snk

#: The controls of the pages, by number.
KEYS = ("smagan", "mangsbodarna", "risberg", "evertsberg", "oxberg", "hokberg", "eldris", "mora")
NAMES = ("Smågan", "Mångsbodarna", "Risberg", "Evertsberg", "Oxberg", "Hökberg", "Eldris", "Mora mål")
KEYS_SQL = "[" + ", ".join(f"'{k}'" for k in KEYS) + "]"
STATUS_TEXT = {"FINISHED": "I mål", "DNF": "Brutit", "STARTAT": "Startat", "DNS": "Ej start", "DSQ": "Diskvalificerad"}


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts))


def detail(m: Model) -> DataFrame:
    """A page a result, in one of three layouts by its id: rows of class split (the second is a forecast), cells that
    name the control by their class, or a table with a header."""
    layout, n = F.col("id") % 3, lambda s: s["sequence_no"] - 1
    named = lambda values, s: F.get(F.array(*map(F.lit, values)), n(s))
    rows = lambda s: _text('<tr class="f-time_0', s["sequence_no"], F.when(s["sequence_no"] == 2, " split estimated").otherwise(" split"), '"><th class="desc">', named(NAMES, s), '</th><td class="time">', clock(s["elapsed_seconds"]), '</td><td class="diff right">', clock(s["segment_seconds"]), '</td><td class="place">', s["place_overall"], "</td></tr>")
    cells = lambda s: _text('<tr><td class="last f-time_', named(KEYS, s), '"> ', clock(s["elapsed_seconds"]), "</td></tr>")
    table = lambda s: _text("<tr><td>", named(NAMES, s), "<td>", clock(s["elapsed_seconds"]), "<td>", s["place_overall"], "</tr>")
    own = m.placed_splits.groupBy(F.col("result_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("sequence_no", "elapsed_seconds", "segment_seconds", "place_overall"))).alias("own"))
    joined = lambda f: F.array_join(F.transform("own", f), "\n")
    head = "<tr><th>Kontroll</th><th>Mellantid</th><th>Plac.</th></tr>"
    passed = F.when(layout == 0, joined(rows)).when(layout == 1, joined(cells)).otherwise(_text(head, joined(table)))
    row = lambda css, label, value: _text(f'<tr class="{css}"><th class="desc">{label}</th><td class="{css} last">', value, "</td></tr>")
    status = F.create_map(*(F.lit(x) for pair in STATUS_TEXT.items() for x in pair))
    stated = _text(
        row("f-__fullname", "Namn", _text(F.col("name"), " (", F.left("nationality", F.lit(3)), ")")), row("f-start_no_text", "Startnummer", F.col("bib")), row("f-sex", "Kön", F.when(F.col("sex") == "M", "Herr").when(F.col("sex") == "F", "Dam")), row("f-age_class", "Klass", F.col("age_class")),
        _text("<tr><td>Klubb</td><td> <b>", F.col("club"), "</b></td></tr>"), row("f-time_finish_brutto", "Totaltid (Brutto)", clock(F.col("finish_seconds"))), row("f-place_nosex", "Plac. (Totalt)", F.col("overall_place")), row("f-__race_status", "Status", F.element_at(status, F.col("status"))),
    )
    link = _text('<div><a href="/?content=detail&amp;idp=R', F.col("id"), '&x=1">', F.col("name"), "</a></div>")
    html = _text("<!doctype html><html><body>", link, "<table><tbody>", stated, "</tbody></table><table>", passed, "</table></body></html>")
    return m.placed_results.join(own, "id", "left").select("id", html.alias("html"))


@query("src_json_config", "SELECT race_id, checkpoint_key, sequence_no, distance_km FROM checkpoints")
def src_json_config(m: Model) -> DataFrame:
    """The catalogue written as one JSON file a race and read again."""
    path = scratch.folder(m.spark, "catalogue")
    controls = F.transform(F.array_sort(F.collect_list(F.struct("sequence_no", "checkpoint_key", "distance_km"))), lambda c: F.struct(c["checkpoint_key"].alias("checkpoint_key"), c["distance_km"].alias("distance_km")))
    races = m.checkpoints.groupBy("race_id").agg(controls.alias("checkpoints"))
    races.select(F.to_json(F.struct(F.array(F.struct("race_id", "checkpoints")).alias("races")), {"pretty": "true"}).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    found = src.catalogue(m.spark, path)
    return found.select("race_id", "checkpoint.checkpoint_key", "sequence_no", "checkpoint.distance_km")


WIDE = "SELECT result_id AS source_id, 'c' || sequence_no AS checkpoint_key, elapsed_seconds FROM splits"


def _table(m: Model) -> DataFrame:
    at = lambda n: F.max(F.when(F.col("sequence_no") == n, clock(F.col("elapsed_seconds")))).alias(f"c{n}")
    s = m.splits.groupBy(F.col("result_id").alias("id")).agg(*map(at, range(1, CONTROLS + 1)))
    return m.results.select(F.col("id").cast("string").alias("Startnummer"), F.col("name").alias("Namn"), "id").join(s, "id", "left").drop("id")


@query("src_csv_mapmap", f"SELECT * FROM ({WIDE})")
def src_csv_mapmap(m: Model) -> DataFrame:
    rows = _table(m)
    return src.mapped(rows, src.header_map(rows.columns, [f"c{n}" for n in range(1, CONTROLS + 1)]))[1].withColumn("source_id", F.col("source_id").cast("long"))


@query("src_csv_import", "SELECT CASE WHEN id % 10 = 0 THEN 16 ELSE length(id::VARCHAR) END AS id_chars, name FROM results")
def src_csv_import(m: Model) -> DataFrame:
    """Every tenth row has no bib, and an id made of its content."""
    rows = _table(m)
    rows = rows.withColumn("Startnummer", F.when(F.col("Startnummer").cast("long") % 10 != 0, F.col("Startnummer")))
    return src.mapped(rows, src.header_map(rows.columns))[0].select(F.length("source_id").alias("id_chars"), "name")


@query("src_csv_flex", "SELECT id, name FROM results")
def src_csv_flex(m: Model) -> DataFrame:
    """The results written with each of the delimiters, each file sniffed and read."""
    out, path = None, scratch.folder(m.spark, "csv")
    for i, d in enumerate(src.DELIMITERS):
        part = f"{path}/{i}"
        m.results.filter(F.col("id") % len(src.DELIMITERS) == i).select("id", "name", F.lit("x").alias("rest")).write.option("header", True).option("sep", d).csv(part)
        rows = src.flexible_csv(m.spark, part).select(F.col("id").cast("long").alias("id"), "name")
        out = rows if out is None else out.unionByName(rows)
    return out


DETAIL = f"""SELECT r.id::VARCHAR AS id, r.name, r.bib, CASE r.sex WHEN 'F' THEN 'F' ELSE 'M' END AS sex, r.age_class, upper(left(r.nationality, 3)) AS nationality, r.club,
 CASE WHEN r.finish_seconds IS NULL AND e.mora IS NOT NULL THEN 'FINISHED' WHEN r.status IN ('FINISHED', 'DNF', 'DNS', 'DSQ') THEN r.status WHEN r.status = 'STARTAT' OR r.finish_seconds IS NULL THEN 'UNKNOWN' ELSE 'FINISHED' END AS status,
 coalesce(r.finish_seconds, e.mora)::BIGINT AS finish_seconds, coalesce(r.finish_seconds, e.mora)::BIGINT AS gun_seconds, r.overall_place,
 coalesce(e.n, 0) + CASE WHEN r.finish_seconds IS NOT NULL AND e.mora IS NULL THEN 1 ELSE 0 END AS splits
 FROM results r LEFT JOIN (SELECT result_id, count(*) AS n, max(elapsed_seconds) FILTER (sequence_no = {LAST}) AS mora FROM seen GROUP BY 1) e ON e.result_id = r.id"""
SEEN = "SELECT * FROM splits WHERE NOT (sequence_no = 2 AND result_id % 3 = 0)"


@query("src_html_detail", DETAIL, seen=SEEN)
def src_html_detail(m: Model) -> DataFrame:
    status = pages.participants(detail(m), KEYS)
    return status.select("id", "name", "bib", "sex", "age_class", "nationality", "club", "status", "finish_seconds", "gun_seconds", "overall_place", F.size("splits").alias("splits"))


@query("src_html_selectors", "SELECT id, bib FROM results")
def src_html_selectors(m: Model) -> DataFrame:
    return detail(m).select("id", src.by_class(F.col("html"), ["f-none", "f-start_no_text"]).alias("bib"))


@query("src_html_labels", "SELECT id, club FROM results")
def src_html_labels(m: Model) -> DataFrame:
    return detail(m).select("id", F.get(F.filter(src.labelled_cells(F.col("html")), lambda x: x["label"] == "klubb"), 0)["value"].alias("club"))


@query("src_html_splits", f"SELECT result_id::VARCHAR AS id, ({KEYS_SQL})[sequence_no] AS checkpoint_key, elapsed_seconds, CASE result_id % 3 WHEN 0 THEN segment_seconds END AS segment_seconds, CASE WHEN result_id % 3 <> 1 THEN place_overall END AS place, false AS is_synthetic FROM seen"
       f" UNION ALL SELECT r.id::VARCHAR, 'mora', r.finish_seconds, NULL, NULL, true FROM results r WHERE finish_seconds IS NOT NULL AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.result_id = r.id AND sequence_no = {LAST})", seen=SEEN)  # fmt: skip
def src_html_splits(m: Model) -> DataFrame:
    rows = pages.participants(detail(m), KEYS).select("id", F.explode("splits").alias("s"))
    return rows.select("id", "s.checkpoint_key", "s.elapsed_seconds", "s.segment_seconds", F.col("s.place_gender").alias("place"), "s.is_synthetic")


@query("src_html_links", "SELECT 'R' || id AS idp FROM results")
def src_html_links(m: Model) -> DataFrame:
    return src.participants(detail(m).unionByName(detail(m).filter("id % 2 = 0")))


@query("src_html_entries", "SELECT 'R' || id AS idp, name, CASE WHEN id % 2 = 0 THEN bib ELSE bib || 'x' END AS bib, club FROM results")
def src_html_entries(m: Model) -> DataFrame:
    """List pages of about 20 participants; every participant is on a second list with other fields, of which only new ones count."""
    item = lambda bib, club: _text('<li><a class="x" href="?pid=list&amp;idp=R', F.col("id"), '">', F.col("name"), '</a> <span class="f-start_no_text">', bib, '</span><span class="f-club">', club, "</span></li>")
    page = lambda rows, no: rows.groupBy(no.alias("page")).agg(F.concat(F.lit("<ul>"), F.array_join(F.array_sort(F.collect_list("item")), ""), F.lit("</ul>")).alias("html"))
    r = m.results
    first = page(r.select("id", item(F.when(F.col("id") % 2 == 0, F.col("bib")), F.lit(None).cast("string")).alias("item")), F.floor(F.col("id") / 20))
    second = page(r.select("id", item(F.concat("bib", F.lit("x")), F.col("club")).alias("item")), F.floor(F.col("id") / 20) + 1_000_000_000)
    return pages.entries(first.unionByName(second)).select("idp", "name", "bib", "club")


@query("src_html_events", "SELECT 'E' || race_id AS code, CASE family WHEN 'short' THEN 'Lopp 45' ELSE 'Lopp 90' END AS label, year FROM races")
def src_html_events(m: Model) -> DataFrame:
    option = F.concat(F.lit('<option value="E'), F.col("race_id").cast("string"), F.lit('">'), F.when(F.col("family") == "short", "Lopp 45").otherwise("Lopp 90"), F.lit('</option><option value="Z">Annat</option>'))
    html = F.concat(F.lit('<select><optgroup label="År '), F.col("year").cast("string"), F.lit('">'), option, F.lit("</optgroup></select>"))
    return src.events(m.races.select(F.lit(1900).alias("path_year"), html.alias("html")))


@query("src_fetch_cache", "SELECT page_id, length(html)::BIGINT AS chars FROM pages")
def src_fetch_cache(m: Model) -> DataFrame:
    """Pages kept as files, one each, and read again."""
    path = scratch.folder(m.spark, "cache")
    m.table("pages").select(F.col("page_id"), F.col("html").alias("value")).repartition("page_id").write.partitionBy("page_id").option("lineSep", "\u0001").text(path)
    kept = m.spark.read.text(path, wholetext=True)
    return kept.select(F.col("page_id").cast("long").alias("page_id"), (F.length("value") - 1).alias("chars"))


@query("src_paginate", "SELECT id, min(page) AS page FROM e GROUP BY id HAVING min(page) <= (SELECT coalesce(min(page), 100000) FROM (SELECT page, sum(CASE WHEN fresh = 0 THEN 1 ELSE 0 END) OVER (ORDER BY page ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM (SELECT p.page, count(f.id) AS fresh FROM (SELECT DISTINCT page FROM e) p LEFT JOIN (SELECT id, min(page) AS page FROM e GROUP BY 1) f USING (page) GROUP BY 1)) WHERE s >= 2)",
       e="SELECT o_custkey AS id, o_orderkey // 20 AS page FROM orders")
def src_paginate(m: Model) -> DataFrame:
    e = m.table("orders").select(F.col("o_custkey").alias("id"), F.floor(F.col("o_orderkey") / 20).alias("page"), F.col("o_orderkey").alias("pos"))
    return src.paginate(e).select("id", "page")


@query("src_json_keymap", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS value FROM events")
def src_json_keymap(m: Model) -> DataFrame:
    rows = m.table("events").select("event_id", F.from_json("props", "map<string, string>").alias("record"))
    return src.decoded(rows, {"k": "value"}).select("event_id", F.col("record")["value"].cast("long").alias("value"))


@query("src_json_discover", "SELECT path, score, count(*) AS size FROM (SELECT '$.data.y' || race_id || '_' || (id // 1000) || '.rows' AS path, CASE WHEN race_id % 10 = 1 THEN 7.0::DOUBLE ELSE 5.0::DOUBLE END AS score FROM results) GROUP BY ALL")
def src_json_discover(m: Model) -> DataFrame:
    """A document a thousand results of a race, under a path of its own, beside lists that hold none; those of long races state no time."""
    short = F.col("race_id") % 10 == 1
    row = F.struct(F.col("name").alias("Namn"), F.col("bib").alias("startnr"), F.col("year").alias("År"), F.when(short, F.coalesce("finish_seconds", F.lit(0))).alias("sluttid"))
    part = F.concat_ws("_", "race_id", F.floor(F.col("id") / 1000)).alias("part")
    races = m.results.groupBy(part).agg(F.to_json(F.struct(F.collect_list(row).alias("rows"), F.array(F.lit(1), F.lit(2)).alias("ids"), F.array(F.struct(F.lit(1).alias("x"))).alias("points")), {"ignoreNullFields": "true"}).alias("j"))
    one = races.select(F.concat(F.lit("var data = {\"data\": {\"y"), F.col("part"), F.lit("\": "), "j", F.lit("}};")).alias("value"))
    path = scratch.folder(m.spark, "feed")
    one.repartition("value").write.option("maxRecordsPerFile", 1).text(path)
    return feeds.collections(feeds.payloads(m.spark, path)).select("path", "score", "size")


@query("src_json_group", "SELECT result_id, max(elapsed_seconds) AS finish_seconds, count(*) AS splits FROM splits GROUP BY 1")
def src_json_group(m: Model) -> DataFrame:
    flat = m.splits.select(F.lit(2020).alias("year"), F.col("result_id").cast("string").alias("external_id"), F.lit("n").alias("name"), F.lit("1").alias("bib"), F.col("checkpoint_key").alias("control"), "elapsed_seconds")
    return src.nested(flat).select(F.substring_index("key", "|", -1).cast("long").alias("result_id"), "finish_seconds", F.size("splits").alias("splits"))


@query("src_json_wide", "SELECT result_id, 'c' || sequence_no AS control, elapsed_seconds FROM splits")
def src_json_wide(m: Model) -> DataFrame:
    wide = m.splits.groupBy("result_id").agg(*(F.max(F.when(F.col("sequence_no") == i, F.col("elapsed_seconds"))).alias(f"c{i}_tid") for i in range(1, 9)))
    return src.unpivoted(wide, "result_id")


@query("src_json_nested", "SELECT result_id, 'c' || sequence_no AS control, elapsed_seconds FROM splits")
def src_json_nested(m: Model) -> DataFrame:
    lists = m.splits.groupBy("result_id").agg(F.collect_list(F.struct(F.col("checkpoint_key").alias("control"), "elapsed_seconds")).alias("splits"))
    maps = lists.select("result_id", F.map_from_entries("splits").alias("splits"))
    return src.exploded(lists.filter("result_id % 2 = 0"), "result_id").unionByName(src.exploded(maps.filter("result_id % 2 = 1"), "result_id"))


@query("src_json_record", """SELECT CASE WHEN id % 3 = 0 THEN 'P' || athlete_id WHEN id % 3 = 1 THEN 'R' || id ELSE left(sha1(year || '|' || name || '|' || bib || '|' || coalesce(f::VARCHAR, 'None') || '|' || id), 20) END AS external_id, year, name, upper(left(nationality, 3)) AS nationality, coalesce(f, l)::BIGINT AS finish_seconds, coalesce(n, 0) AS splits
 FROM (SELECT *, nullif(finish_seconds, 0) AS f FROM results) LEFT JOIN (SELECT result_id, count(*) AS n, max(elapsed_seconds) FILTER (sequence_no = 8) AS l FROM splits GROUP BY 1) ON result_id = id""")
def src_json_record(m: Model) -> DataFrame:
    """Records of all results, with their passages as lists, as objects by control or as columns."""
    i, key = F.col("id"), lambda n: F.get(F.array(*map(F.lit, NAMES)), n - 1)
    s = m.splits.groupBy(F.col("result_id").alias("id")).agg(F.collect_list(F.struct(key(F.col("sequence_no")).alias("control"), clock(F.col("elapsed_seconds")).alias("elapsed_time"))).alias("splits"))
    record = F.struct(F.when(i % 3 == 0, F.concat(F.lit("P"), "athlete_id")).alias("idpe"), F.when(i % 3 == 1, F.concat(F.lit("R"), "id")).alias("idp"), F.concat("name", F.lit(" ("), F.upper(F.left("nationality", F.lit(3))), F.lit(")")).alias("Full name"), "bib", F.col("year").alias("race_year"), F.nullif("finish_seconds", F.lit(0)).alias("bruttotid"), "splits")
    records = m.results.join(s, "id", "left").select(F.to_json(record).alias("record"), i.alias("index"))
    found = feeds.results(records, years=(1900, 2100))
    return found.select("external_id", "year", "name", "nationality", "finish_seconds", F.size("splits").alias("splits"))


@query("src_json_load", "SELECT id, bib FROM results")
def src_json_load(m: Model) -> DataFrame:
    """Files of JSON and of scripts around JSON, each with a list of a thousand."""
    path = scratch.folder(m.spark, "json")
    lists = m.results.groupBy(F.floor(F.col("id") / 1000).alias("part")).agg(F.to_json(F.collect_list(F.struct("id", "bib"))).alias("j"))
    text = F.when(F.col("part") % 2 == 0, F.col("j")).otherwise(F.concat(F.lit("window.DATA="), "j", F.lit(";")))
    lists.select(text.alias("value")).repartition("value").write.option("maxRecordsPerFile", 1).text(path)
    rows = feeds.payloads(m.spark, path).select(F.explode(F.from_json("payload", "array<struct<id: long, bib: string>>")).alias("r"))
    return rows.select("r.*")


@geometry("src_gpx", "SELECT route_id, idx, lat, elev FROM pts")
def src_gpx(m: Model) -> DataFrame:
    texts = snk.track_xml(points(m), "made by rule")
    return texts.select("route_id", F.posexplode(src.track_points(F.col("gpx"))).alias("idx", "p")).select("route_id", "idx", "p.lat", "p.elev")


@geometry("src_kmz", "SELECT route_id, idx, lat FROM pts")
def src_kmz(m: Model) -> DataFrame:
    """Archives, one a route, written and read again; a second, shorter line in each doesn't count."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "lat", "lon"))), lambda p: F.concat_ws(",", p["lon"], p["lat"], F.lit(0))), "\n")
    kml = points(m).groupBy("route_id").agg(F.concat(F.lit("<kml><coordinates>1,1,1</coordinates><coordinates>"), body, F.lit("</coordinates></kml>")).alias("kml"))
    path = scratch.folder(m.spark, "kmz")
    snk.archives(kml.select(F.concat(F.lit("route-"), F.col("route_id").cast("string"), F.lit(".kmz")).alias("name"), F.col("kml").alias("text")), path, "doc.kml")
    return src.archived_tracks(m.spark, path).select(F.regexp_extract("path", r"route-(\d+)", 1).cast("long").alias("route_id"), "idx", "lat")


@query("src_payload", "SELECT race_id, race_key FROM races")
def src_payload(m: Model) -> DataFrame:
    """The races as a script that a browser loads, read for its data."""
    path = scratch.folder(m.spark, "payload")
    snk.export_json({"races": m.races.select("race_id", "race_key")}, path, "DATA")
    lines = m.spark.read.text(f"{path}/races.js").select(src.wrapped_json(F.regexp_extract("value", r"(?s)\.push\((.*)\);", 1)).alias("j"))
    return lines.select(F.from_json("j", "race_id int, race_key string").alias("r")).select("r.*")


NEW = "SELECT race_id, id, status, finish_seconds, age_class FROM sources WHERE priority = 2 AND id % 2 = 0 UNION ALL SELECT race_id, id + 10000000, status, finish_seconds, age_class FROM sources WHERE priority = 2 AND id % 100 = 1"


def _new(m: Model) -> DataFrame:
    s = m.sources.filter("priority = 2").select("race_id", "id", "status", "finish_seconds", "age_class")
    return s.filter("id % 2 = 0").unionByName(s.filter("id % 100 = 1").withColumn("id", F.col("id") + 10_000_000))


@query("snk_upsert_result", "SELECT coalesce(n.race_id, r.race_id) AS race_id, coalesce(n.id, r.id) AS id, coalesce(n.status, r.status) AS status, coalesce(n.finish_seconds, r.finish_seconds) AS finish_seconds FROM results r FULL JOIN n ON n.race_id = r.race_id AND n.id = r.id", n=NEW)
def snk_upsert_result(m: Model) -> DataFrame:
    return snk.upsert(m.results, _new(m), ["race_id", "id"], ["status", "finish_seconds"])


@query("snk_upsert_split", "SELECT result_id, checkpoint_key, CASE WHEN result_id % 5 = 0 THEN elapsed_seconds + 1 ELSE elapsed_seconds END AS elapsed_seconds FROM splits")
def snk_upsert_split(m: Model) -> DataFrame:
    new = m.splits.filter("result_id % 5 = 0").withColumn("elapsed_seconds", F.col("elapsed_seconds") + 1)
    return snk.upsert(m.splits, new, ["result_id", "checkpoint_key"], ["elapsed_seconds"])


@query("snk_upsert_catalogue", """SELECT race_id, checkpoint_key, sequence_no, distance_km + CASE WHEN race_id % 10 = 1 THEN 1 ELSE 0 END AS distance_km FROM checkpoints UNION ALL SELECT race_id, 'extra', 9, 50.0::DOUBLE FROM races""")
def snk_upsert_catalogue(m: Model) -> DataFrame:
    new = m.checkpoints.withColumn("distance_km", F.col("distance_km") + 1)
    extra = m.races.select("race_id", F.lit("extra").alias("checkpoint_key"), F.lit("Extra").alias("name"), F.lit(3).alias("sequence_no"), F.lit(50.0).alias("distance_km"))
    used = m.races.filter("race_id % 10 = 0").select("race_id")
    return snk.upsert_catalogue(m.checkpoints, new.unionByName(extra), used).select("race_id", "checkpoint_key", "sequence_no", "distance_km")


@query("snk_provenance", "SELECT page_id, sha256(html) AS sha256 FROM pages WHERE page_id % 3 <> 0")
def snk_provenance(m: Model) -> DataFrame:
    p = m.table("pages")
    return snk.record(p.filter("page_id % 3 = 0").withColumn("sha256", F.sha2("html", 256)), p, ["page_id"], "html")


@query("snk_delete_reload", "SELECT id, year FROM results WHERE year <> 1997 UNION ALL SELECT id, year FROM results WHERE year = 1997 AND id % 2 = 0")
def snk_delete_reload(m: Model) -> DataFrame:
    rows = m.results.select("id", "year")
    return snk.replace_source(rows, rows.filter("year = 1997 and id % 2 = 0"), ["year"])


@query("snk_enrich_splits", "SELECT 1 AS pass, CASE WHEN result_id % 6 = 0 THEN 'insert' WHEN result_id % 5 = 0 THEN 'update' ELSE 'noop' END AS action, count(*) AS n FROM splits GROUP BY ALL UNION ALL SELECT 2, 'noop', count(*) FROM splits")
def snk_enrich_splits(m: Model) -> DataFrame:
    new = m.splits.withColumn("elapsed_seconds", F.when(F.col("result_id") % 5 == 0, F.col("elapsed_seconds") + 1).otherwise(F.col("elapsed_seconds")))
    _, first, second = snk.enrich(m.splits.filter("result_id % 6 <> 0"), new, ["result_id", "sequence_no"], ["elapsed_seconds"], {"athletes": m.athletes, "races": m.races})
    return first.select(F.lit(1).alias("pass"), "action", "n").unionByName(second.select(F.lit(2).alias("pass"), "action", "n"))


@query("snk_export_json", "SELECT 'result' AS kind, id, finish_seconds, status, NULL::BIGINT AS n FROM results UNION ALL SELECT 'results', NULL, NULL, NULL, count(*) FROM results UNION ALL SELECT 'races', NULL, NULL, NULL, count(*) FROM races UNION ALL SELECT 'splits', NULL, NULL, NULL, count(*) FROM splits")
def snk_export_json(m: Model) -> DataFrame:
    """What an export holds when read again, and its manifest; nulls are left out and come back as nulls."""
    path = scratch.folder(m.spark, "export")
    rows = m.results.select("id", "finish_seconds", known(F.col("status")).alias("status"))
    snk.export_json({"races": m.races, "results": rows, "splits": m.splits}, path)
    back = m.spark.read.schema("id long, finish_seconds long, status string").json(f"{path}/results")
    manifest = m.spark.read.schema("table string, rows long").json(f"{path}/manifest")
    back = back.select(F.lit("result").alias("kind"), "id", "finish_seconds", F.coalesce("status", F.lit("")).alias("status"), F.lit(None).cast("long").alias("n"))
    return back.unionByName(manifest.select(F.col("table").alias("kind"), F.col("rows").alias("n")), allowMissingColumns=True)


@query("snk_atomic", "SELECT race_id, year + 1 AS year FROM races")
def snk_atomic(m: Model) -> DataFrame:
    """Replaced as a whole, once by other rows and once in vain by a write that fails."""
    target = scratch.folder(m.spark, "atomic")
    snk.atomic(m.races.select("race_id", "year"), target)
    snk.atomic(m.races.select("race_id", (F.col("year") + 1).alias("year")), target)
    try:
        snk.atomic(m.races.select("race_id", F.raise_error(F.lit("no")).alias("year")), target)
    except Exception:  # whatever fails a write
        pass
    return m.spark.read.parquet(target)


@geometry("snk_route_json", "SELECT route_id, count(*) AS points, max(km) AS km FROM mes GROUP BY 1")
def snk_route_json(m: Model) -> DataFrame:
    docs = snk.route_document(measured(m))
    p = F.from_json("document", "points array<array<double>>")["points"]
    return docs.select("route_id", F.size(p).alias("points"), F.array_max(F.transform(p, lambda x: F.get(x, 2))).alias("km"))


@geometry("snk_gpx", "SELECT route_id, count(*) AS points FROM pts GROUP BY 1")
def snk_gpx(m: Model) -> DataFrame:
    return snk.track_xml(points(m), "reference").select("route_id", F.regexp_count("gpx", F.lit("<trkpt ")).alias("points"))


@query("snk_map_payload", "SELECT result_id, count(*) AS splits FROM splits WHERE result_id IN (1, 2, 3, 5, 8) GROUP BY 1")
def snk_map_payload(m: Model) -> DataFrame:
    _, s = snk.subset(m.results, m.splits, [1, 2, 3, 5, 8, 1])
    return s.groupBy("result_id").agg(F.count("*").alias("splits"))
