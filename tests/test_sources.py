"""Readers of pages and feeds on texts in their real layouts, and the jobs over a store."""

import json
import zipfile

import pytest

from tempotrail import jobs
from tempotrail.sources import feeds, pages, readers, sinks

CONTROLS = ("start", "smagan", "mangsbodarna", "risberg", "evertsberg", "oxberg", "hokberg", "eldris", "mora")
NAMES = ("Smågan", "Mångsbodarna", "Risberg", "Evertsberg", "Oxberg", "Hökberg", "Eldris", "Mål")
TIMES = (2476, 6504, 9716, 13250, 17598, 20416, 23539, 26280)


def clock(s):
    return f"{s // 3600:02}:{s // 60 % 60:02}:{s % 60:02}"


def page(fields, passed, extra=""):
    rows = "".join(f'<tr class="{c}"><th class="desc">{label}</th><td class="{c} last">{value}</td></tr>' for c, label, value in fields)
    return f'<!doctype html><html lang="sv"><body><div class="detail"><table><tbody>{rows}</tbody></table>{extra}<table class="table"><thead><tr><th>Kontroll</th><th>Klockan</th><th>Tid</th><th>Sträcktid</th><th>min/km</th><th>km/h</th><th>Plac.</th></tr></thead><tbody>{passed}</tbody></table></div></body></html>'


FIELDS = [
    ("f-__fullname", "Namn", "Ek, Bo (SWE)"), ("f-club", "Klubb/Stad", "Norr SS"), ("f-start_no_text", "Startnummer", "1025"), ("f-_type_age_class", "Klass", "M21"), ("f-place_all", "Placering", "20"), ("f-place_age", "Placering (Klass)", "11"),
    ("f-place_nosex", "Plac. (Totalt)", "22"), ("f-time_finish_brutto", "Totaltid (Brutto)", clock(TIMES[-1])), ("f-__race_status", "Status", "I mål"),
]
ROWS = "".join(
    f'<tr class="f-time_0{i} split"><th class="desc">{n}</th><td class="time_day">{clock(18_000 + t)}</td><td class="time">{clock(t)}</td><td class="diff right">{clock(t - (0, *TIMES)[i - 1])}</td><td class="min_km right">04:41</td><td class="kmh right">12,85</td><td class="place right">{40 - i}</td></tr>'
    for i, (n, t) in enumerate(zip(NAMES, TIMES, strict=True), 1)
)


def test_a_whole_participant_page():
    r = pages.participant(page(FIELDS, ROWS), CONTROLS)
    assert (r["name"], r["nationality"], r["bib"], r["age_class"], r["sex"], r["status"], r["club"], r["city"]) == ("Ek, Bo", "SWE", "1025", "M21", "M", "FINISHED", "Norr SS", None)
    assert (r["finish_seconds"], r["overall_place"], r["gender_place"], r["class_place"]) == (26_280, 22, 20, 11)
    assert [s["elapsed"] for s in r["splits"]] == list(TIMES) and [s["checkpoint_key"] for s in r["splits"]] == list(CONTROLS[1:])
    first = r["splits"][0]
    assert (first["time_of_day"], first["segment"], first["pace"], first["speed"], first["place"]) == ("05:41:16", 2476, 281, 12.85, 39)
    assert json.loads(r["raw"])["labeled_values"]["age_class"] == "M21"


def test_forecasts_are_no_passages():
    rows = ROWS.replace('class="f-time_07 split"', 'class="f-time_07 split estimated"').replace('<td class="time">07:18:00</td>', '<td class="time">07:18:00 <strong>*</strong></td>')
    r = pages.participant(page([f for f in FIELDS if f[0] not in ("f-time_finish_brutto", "f-__race_status")], rows), CONTROLS)
    assert len(r["splits"]) == 6 and r["finish_seconds"] is None and r["status"] == "UNKNOWN"


def test_cells_correct_times_and_tables_fill_gaps():
    cells = '<table><tr><td class="f-time_smagan">00:41:00</td></tr></table><span class="f-time_oxberg">4:50:00</span>'
    table = "<table><tr><th>Kontroll<th>Klockslag<th>Mellantid<th>Efter<th>Plac.</tr><tr><td>Smågan<td>05:41:16<td>0:59:59<td>+0:30<td>5</tr><tr><td>Lillsjön<td>06:00:00<td>1:00:00<td>-1:00<td>9</tr><tr><td>Annat<td>x<td>1:00:00</tr></table>"
    one = '<tr class="split"><th class="desc">Smågan</th><td class="time">0:41:16</td></tr>'
    r = pages.passages(pages.elements(page([], one, cells + table)), ("smagan", "lillsjon", "oxberg"))
    assert [(s["checkpoint_key"], s["elapsed"]) for s in r] == [("smagan", 2460), ("lillsjon", 3600), ("oxberg", 17_400)]
    assert r[0]["behind"] is None and r[0]["place"] is None  # a row has stated these, as nothing
    assert r[1]["behind"] == -60 and r[1]["place"] == 9 and r[1]["time_of_day"] == "06:00:00"


@pytest.mark.parametrize(("fields", "body", "status", "finish"), [
    ([("f-status", "Status", "Brutit")], "", "DNF", None), ([], "<p>Runner did not start</p>", "DNS", None), ([("f-time_finish_netto", "Netto", "8:00:00")], "", "FINISHED", 28_800), ([], "", "UNKNOWN", None), ([("f-status", "Status", "Startat")], "", "UNKNOWN", None),
])
def test_status_of_a_page(fields, body, status, finish):
    r = pages.participant(page(fields, "", body), CONTROLS)
    assert (r["status"], r["finish_seconds"]) == (status, finish)
    assert [s.get("synthetic") for s in r["splits"]] == ([True] if finish else [])


def test_a_finish_row_corrects_the_finish():
    wrong = [*FIELDS[:-2], ("f-time_finish_brutto", "Totaltid (Brutto)", "12:18:00")]
    r = pages.participant(page(wrong, ROWS), CONTROLS)
    assert (r["finish_seconds"], r["gun_seconds"], r["status"]) == (26_280, 26_280, "FINISHED")


def test_pages_without_sense(spark):
    assert pages.participant(None, CONTROLS)["status"] == "UNKNOWN" and pages.participant("<td></tr><<>&", CONTROLS)["splits"] == []
    rows = pages.participants(spark.createDataFrame([(1, None), (2, page(FIELDS, ROWS))], "id int, html string"), CONTROLS).collect()
    assert {r["id"]: len(r["splits"]) for r in rows} == {"1": 0, "2": 8} and pages.participants(spark.createDataFrame([], "id int, html string"), CONTROLS).count() == 0


def test_entries_keep_the_first_value(spark):
    item = '<li><a href="/?a=1&amp;idp={0}">{1}</a><span class="f-club">{2}</span></li>'
    lists = [(2, item.format("A", "Other", "Late")), (1, "<ul>" + item.format("A", "Ann", "") + item.format("B", "", "Norr") + "</ul><a href='/x'>no</a>")]
    found = {r["idp"]: (r["name"], r["club"]) for r in pages.entries(spark.createDataFrame(lists, "page int, html string")).collect()}
    assert found == {"A": ("Ann", "Late"), "B": (None, "Norr")}


def test_feeds_of_any_shape(spark, tmp_path):
    rows = [{"År": 2020, "Namn": "Ann Ek (NOR)", "startnr": 5, "bruttotid": "10:30:00", "placering_totalt": 7, "klass": "D21"}, {"År": 1900, "Namn": "Old"}, {"År": 2020, "Namn": "Bo", "splits": {"Smågan": "0:50:00", "Mora": {"time": "11:00:00", "place": 3}}}]
    (tmp_path / "a.js").write_text("﻿window.X = " + json.dumps({"deep": [{"list": rows}], "other": [1, {"x": 2}]}) + ";")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.json").write_text(json.dumps([{"Z": "Cec", "b": "9:00:00", "A": 2021}]))
    (tmp_path / "c.txt").write_text("no json here")
    (tmp_path / "manifest.json").write_text("[]")
    found = feeds.collections(feeds.payloads(spark, tmp_path.as_uri()), {"Z": "name", "b": "time", "A": "year"}).collect()
    assert {(r["path"], r["size"]) for r in found} == {("$.deep[0].list", 3), ("$", 1)}
    records = spark.createDataFrame([(x, i) for r in found for i, x in enumerate(r["records"])], "record string, index long")
    got = {r["name"]: r for r in feeds.results(records).collect()}
    assert set(got) == {"Ann Ek", "Bo", "Cec"} and got["Cec"]["finish_seconds"] == 32_400
    assert (got["Ann Ek"]["nationality"], got["Ann Ek"]["sex"], got["Ann Ek"]["bib"], got["Ann Ek"]["overall_place"]) == ("NOR", "F", "5", 7)
    assert (got["Bo"]["finish_seconds"], got["Bo"]["status"], [s["checkpoint_key"] for s in got["Bo"]["splits"]]) == (39_600, "FINISHED", ["smagan", "mora"])


def test_flat_and_wide_records():
    wide = feeds.result({"year": 2022, "name": "A", "smagan_tid": "0:45:00", "mal_tid": 37_800_000, "smagan_placering": 4}, None, 0, (2014, 2030))
    assert wide["finish_seconds"] == 37_800 and [s["elapsed_seconds"] for s in wide["splits"]] == [2700, 37_800] and wide["splits"][0]["place_overall"] == 4
    assert feeds.duration("PT1H2M") == 3720 and feeds.duration(10**9) is None and feeds.result({"name": "x"}, None, 0, (2014, 2030)) is None


def test_archives_and_their_lines(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "r.kmz", "w") as z:
        z.writestr("doc.kml", "<kml><coordinates>1,2 3,4</coordinates><x:coordinates>14.0,61.0,5 14.1,61.1 14.2,61.2,7</x:coordinates><coordinates>14.0,61.0,5 14.1,61.1,6 14.2,61.2,7</coordinates></kml>")
    with zipfile.ZipFile(tmp_path / "none.kmz", "w") as z:
        z.writestr("x.txt", "")
    got = sorted((r["idx"], r["lat"], r["elev"]) for r in readers.archived_tracks(spark, str(tmp_path / "*.kmz")).collect())
    assert got == [(0, 61.0, 5.0), (1, 61.1, 6.0), (2, 61.2, 7.0)]


def test_source_ids_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(None, f"n{i % 4}") for i in range(20)] + [("7", "x")], "Startnr string, Namn string")
    ids = [sorted(r["source_id"] for r in readers.mapped(rows.repartition(n), readers.header_map(rows.columns))[0].collect()) for n in (1, 7)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 21


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    target = (tmp_path / "t").as_uri()
    sinks.atomic(spark.range(3), target)

    def broken(df, path):
        df.limit(1).write.parquet(path)
        raise OSError("lost")

    with pytest.raises(OSError):
        sinks.atomic(spark.range(9), target, broken)
    assert spark.read.parquet(target).count() == 3
    sinks.atomic(spark.range(5), target)
    assert spark.read.parquet(target).count() == 5 and not list(tmp_path.glob("t.old*"))


def test_enrichment_is_done_once(spark):
    old = spark.createDataFrame([(1, 1, 10), (1, 2, 20)], "r int, c int, s int")
    new = spark.createDataFrame([(1, 2, 25), (1, 3, 30), (1, 1, 10)], "r int, c int, s int")
    merged, first, second = sinks.enrich(old, new, ["r", "c"], ["s"], {"other": old})
    assert {r["action"]: r["n"] for r in first.collect()} == {"insert": 1, "update": 1, "noop": 1} and {r["action"]: r["n"] for r in second.collect()} == {"noop": 3}
    assert sorted(map(tuple, merged.collect())) == [(1, 1, 10), (1, 2, 25), (1, 3, 30)]


def test_jobs_over_a_store(spark, tmp_path):
    store = (tmp_path / "store").as_uri()
    (tmp_path / "races.json").write_text(json.dumps({"races": [{"race_id": 1, "race_key": "long-2020", "family": "long", "year": 2020, "distance_km": 90.0, "checkpoints": [{"checkpoint_key": k, "name": k, "distance_km": 10.0 * i} for i, k in enumerate(CONTROLS)]}]}))
    (tmp_path / "a.csv").write_text("Namn;Startnr;Sluttid;smagan\nBo Ek;7;8:00:00;0:10:00\nAnn;;;0:11:00\n", encoding="utf-8-sig")
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "R5.html").write_text(page(FIELDS, ROWS))
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "x.json").write_text(json.dumps([{"year": 2020, "name": "Cec", "time": "1:00:00", "id": "c1"}]))
    assert jobs.main(["init", store]) == 0 and jobs.main(["catalogue", store, str(tmp_path / "races.json")]) == 0
    for _ in range(2):  # a second time changes nothing
        jobs.main(["import-csv", store, str(tmp_path / "a.csv"), "--race", "1"])
        jobs.main(["import-pages", store, (tmp_path / "pages").as_uri(), "--race", "1"])
        jobs.main(["import-feed", store, (tmp_path / "feed").as_uri()])
        results, splits = ({tuple(r) for r in jobs.read(spark, store, t).select(*c).collect()} for t, c in (("results", ("source", "name", "finish_seconds")), ("splits", ("source", "checkpoint_key", "elapsed_seconds"))))
        assert results == {("csv", "Bo Ek", 28_800), ("csv", "Ann", None), ("pages", "Ek, Bo", 26_280), ("feed", "Cec", 3600)}
        assert len(splits) == 10 and ("csv", "smagan", 600) in splits
    assert {r["code"]: r["n"] for r in jobs.validate(spark, store).collect()} == {"too_fast": 1} and jobs.main(["validate", store]) == 2
    assert jobs.main(["export", store, (tmp_path / "out").as_uri(), "--wrapper", "DATA"]) == 0
    assert spark.read.text((tmp_path / "out" / "results.js").as_uri()).filter("value like '(window.DATA=%'").count() == 4
