"""Known answers and edge cases of single operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempotrail.functions import maths, text
from tempotrail.operators import aggregates, filters, identity, joins, quality, replay, status, windows
from tempotrail.operators.simplify import kept_indices
from tempotrail.sources import readers, sinks


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_status_summary(spark):
    rows = [(1, "FINISHED", 100), (2, "DNF", None), (3, "DNS", None), (4, "DSQ", None), (5, "", None), (6, "UNKNOWN", None)]
    results = spark.createDataFrame(rows, "id int, status string, finish_seconds int")
    seen = spark.createDataFrame([(6,)], "result_id int")
    s = status.summarize(status.classify(results, seen)).first()
    assert (s.starters, s.finishers, s.dnf, s.dns, s.dsq, s.unknown, s.rate) == (4, 1, 2, 1, 1, 1, 25.0)
    assert s.starters == s.finishers + s.dnf + s.dsq


@pytest.mark.parametrize(("word", "seconds", "split", "category"), [("  startade inte  ", None, False, "dns"), ("DNS", 5, True, "dns"), ("FINISHED", None, False, "dnf"), ("STARTAT", None, False, "dnf"), ("", None, True, "dnf"), (None, None, False, "unknown"), ("DNF", 9999, False, "dnf"), ("godkänd", 10, False, "finished")])
def test_classifier(spark, word, seconds, split, category):
    results = spark.createDataFrame([(1, word, seconds)], "id int, status string, finish_seconds int")
    seen = spark.createDataFrame([(1,)] if split else [], "result_id int")
    assert status.classify(results, seen).first().category == category


def test_fastest_tenth_and_bins(spark):
    twenty = spark.createDataFrame([("a", float(i)) for i in range(1, 21)] + [("b", 8.0)], "g string, v double")
    assert values(aggregates.fastest_tenth(twenty, "v", "g"), "g", "mean", "n") == [("a", 19.5, 2), ("b", 8.0, 1)]
    q = 27_900
    times = spark.createDataFrame([(q,), (q + 899,), (q + 900,), (q + 1799,), (q + 1800,), (q + 4500,)], "finish_seconds long")
    assert [r[1] for r in values(aggregates.bins(times), "start", "n")] == [2, 2, 1, 0, 0, 1]


def test_group_speed(spark):
    rows = spark.createDataFrame([("a", 90.0, 9 * 3600), ("a", 90.0, 10 * 3600), ("b", 90.0, 3600 * 9), ("a", 90.0, 60)], "g string, km double, seconds long")
    got = dict((g, v) for g, v in values(aggregates.group_speed(rows, "g"), "g", "kmh"))
    assert got["a"] == pytest.approx(180 / 19) and got["b"] is None


def test_weighted_median(spark):
    rows = spark.createDataFrame([("x", 0.4, 1.0), ("x", 0.5, 10.0), ("x", 0.9, 1.0)], "g string, v double, w double")
    assert replay.weighted_median(rows, "v", "w", ["g"]).first().v == 0.5


def test_times(spark):
    df = spark.createDataFrame([("7:30:00",), ("59:30",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(text.seconds(F.col("t"))).collect()] == [27_000, 3570, None, None]
    pace = spark.range(1).select(text.pace_text(F.lit(347.0)), text.pace_text(F.lit(239.6)), text.clock(F.lit(27_000)), text.speed_text(F.lit(9.96))).first()
    assert tuple(pace) == ("5:47 /km", "4:00 /km", "7:30:00", "10,0 km/h")


def test_class_order(spark):
    df = spark.createDataFrame([("M100",), ("M21",), ("W40",), ("W21",), ("M35",), ("D30",), ("",)], "c string")
    assert [r[0] for r in df.orderBy(*text.class_order(F.col("c"))).collect()] == ["W21", "D30", "W40", "M21", "M35", "M100", ""]


def test_fold_and_strict(spark):
    rows = [(1, 1, 100, 10.0), (1, 2, None, 20.0), (1, 3, 300, 30.0), (1, 4, 250, 40.0), (1, 5, 400, 50.0)]
    s = spark.createDataFrame(rows, "result_id int, sequence_no int, elapsed_seconds int, distance_km double")
    assert [r.segment for r in windows.fold_segments(s).orderBy("sequence_no").collect()] == [100, None, 200, None, 150]
    gap = s.filter("sequence_no <> 2")
    assert [r.segment for r in windows.strict_segments(gap).orderBy("sequence_no").collect()] == [100, None, -50, 150]


def test_identity(spark):
    known = spark.createDataFrame([(1, "a", "M", 1980), (2, "b", "F", None), (3, "c", "M", 1970), (4, "c", "M", 1971)], "athlete_id int, key string, sex string, birth_year int")
    rows = spark.createDataFrame([(10, "x1", "z", None, None), (11, "n", "a", "M", None), (12, "n2", "a", "F", None), (13, "n3", "c", "M", None), (14, "n4", "c", "M", None)], "row_id int, external_id string, key string, sex string, birth_year int")
    links = spark.createDataFrame([("x1", 2)], "external_id string, athlete_id int")
    got = dict(values(identity.resolve(rows, known, links, 100), "row_id", "athlete_id"))
    assert got[10] == 2 and got[11] == 1 and got[12] >= 100 and got[13] == got[14] >= 100 and got[12] != got[13]


def test_merge_keeps_sentinels_of_the_first(spark):
    rows = spark.createDataFrame([(1, 1, 0, "UNKNOWN", None), (1, 1, 2, "", 5), (2, 2, 0, "", None), (2, 2, 2, "DNF", 7)], "k int, id int, priority int, status string, v int")
    assert values(identity.merge_by_priority(rows, ["k"], ["status", "v"]), "k", "status", "v", "sources") == [(1, "UNKNOWN", 5, 2), (2, "DNF", 7, 2)]


def test_asof(spark):
    points = spark.createDataFrame([(1, 5.0), (1, 10.0), (1, 99.0), (2, 1.0)], "g int, at double")
    anchors = spark.createDataFrame([(1, 0.0), (1, 10.0)], "g int, anchor double")
    got = values(joins.around(points, anchors, "g"), "g", "at", "prev_anchor")
    assert got == [(1, 5.0, 0.0), (1, 10.0, 10.0), (1, 99.0, 10.0), (2, 1.0, None)]


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "id int, x string, y int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 6)], "id int, x string, y int")
    once = sinks.upsert(old, new, ["id"], ["x", "y"])
    assert values(once, "id", "x", "y") == [(1, "a", 1), (2, "b", 5), (3, "c", 6)]
    assert values(sinks.upsert(once, new, ["id"], ["x", "y"]), "id", "x", "y") == values(once, "id", "x", "y")
    assert {r.action for r in sinks.upsert_actions(once, new.filter("id = 3"), ["id"], ["x", "y"]).collect()} == {"noop"}


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, v string")
    manifest = sinks.export_json({"t": df}, str(tmp_path / "out"))
    assert values(manifest, "table", "rows") == [("t", 2)]
    assert "null" not in "".join(r[0] for r in spark.read.text(str(tmp_path / "out/t")).collect())


def test_refuse(spark):
    quality.refuse(spark.range(0), "nothing")
    with pytest.raises(ValueError):
        quality.refuse(spark.range(1), "something")


def test_pagination_stops(spark):
    rows = [(1, 1, "A"), (1, 2, "B"), (2, 1, "B"), (2, 2, "C"), (3, 1, "C"), (4, 1, "C"), (5, 1, "D")]
    e = spark.createDataFrame(rows, "page int, pos int, id string")
    assert [r[0] for r in values(readers.paginate(e), "id")] == ["A", "B", "C"]


def test_simplified_line_stays_near():
    i = np.arange(400)
    line = np.stack([61 + i * 5e-4, 14 + np.sin(i / 30) * 1e-2], axis=1)
    kept = kept_indices(line, 4.0)
    assert kept[0] == 0 and kept[-1] == 399 and 2 < len(kept) < 200
    scale = np.array([111_194.9, 111_194.9 * np.cos(np.radians(61.1))])
    for a, b in zip(kept, kept[1:]):
        p, q, inner = line[a] * scale, line[b] * scale, line[a : b + 1] * scale
        d, e = q - p, inner - p
        assert (np.abs(d[0] * e[:, 1] - d[1] * e[:, 0]) / np.hypot(*d)).max() < 4.1


def test_csv_and_tracks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Namn;Startnr;c1\nBo Ek;7;0:10:00\nAnn;;0:11:00\n")
    rows = readers.flexible_csv(spark, str(tmp_path / "a.csv"))
    results, splits = readers.mapped(rows, readers.header_map(rows.columns, ["c1"]))
    assert {r["name"] for r in results.collect()} == {"Bo Ek", "Ann"} and ("7", "c1", 600) in values(splits, "source_id", "checkpoint_key", "elapsed_seconds")
    (tmp_path / "t.gpx").write_text('<gpx xmlns="x"><trk><trkseg><trkpt lat="61.0" lon="14.0"><ele>300</ele></trkpt><trkpt lat="61.1" lon="14.1"/></trkseg></trk></gpx>')
    assert values(readers.tracks(spark, str(tmp_path / "t.gpx")), "idx", "lat", "elev") == [(0, 61.0, 300.0), (1, 61.1, None)]


def test_medals_and_gaps(spark):
    row = spark.range(1).select(maths.medal_seconds(F.lit("long"), F.lit("post"), F.lit("F")), maths.gap_text(F.lit(75)), maths.gap_text(F.lit(-3675)), maths.gap_text(F.lit(1))).first()
    assert tuple(row) == (41_759, "1:15 före", "1:01:15 efter", "i nivå")


def test_stream_equals_batch(spark, tmp_path):
    from tempotrail.streaming.passages import windowed_counts

    folder = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{folder}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/{{events.parquet}}")
    q = windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert values(spark.table("counts"), "start", "event_type", "n") == values(windowed_counts(events), "start", "event_type", "n")


def test_search_and_sample(spark):
    rows = spark.createDataFrame([(i, f"Name {i}", "IF", str(i), 2000 + i % 3, i) for i in range(30)], "id int, name string, club string, bib string, year int, overall_place int")
    assert filters.search(rows, "name 2").first().year == 2002
    got = sorted(r.id for r in filters.sample(rows.withColumn("g", F.lit(1)), ["id"], "g", 10).collect())
    assert got[0] == 0 and got[-1] == 29 and len(got) == 10
