"""Queries of sections 2.8 and 2.9."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempotrail.functions.text import class_order
from tempotrail.operators import windows as op
from tempotrail.operators.quality import sequence_issues
from tempotrail.plans.aggregates import INDEX, clubs, evolution, finished, people, q, segments
from tempotrail.plans.aggregates import CLUBS, EVOLUTION
from tempotrail.plans.proxy import LAST, MID, Model

#: Passages with gaps and steps back, by rule.
GAPPED = """SELECT result_id, race_id, sequence_no, distance_km, CASE WHEN (result_id + sequence_no) % 9 = 0 THEN NULL WHEN (result_id + sequence_no) % 17 = 0 THEN elapsed_seconds - 4000 ELSE elapsed_seconds END AS elapsed_seconds,
 segment_seconds, place_overall FROM splits WHERE (result_id + sequence_no) % 11 <> 0"""


def gapped(m: Model) -> DataFrame:
    k = F.col("result_id") + F.col("sequence_no")
    elapsed = F.when(k % 9 == 0, None).when(k % 17 == 0, F.col("elapsed_seconds") - 4000).otherwise(F.col("elapsed_seconds"))
    return m.placed_splits.filter(k % 11 != 0).withColumn("elapsed_seconds", elapsed)


W = "OVER (PARTITION BY result_id ORDER BY sequence_no)"
PRE = "OVER (PARTITION BY result_id ORDER BY sequence_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@q("wn_lag_backwards", f"SELECT result_id, sequence_no, elapsed_seconds, previous FROM (SELECT *, lag(elapsed_seconds) {W} AS previous FROM g) WHERE elapsed_seconds < previous", g=GAPPED)
def wn_lag_backwards(m: Model) -> DataFrame:
    return op.backwards(gapped(m)).select("result_id", "sequence_no", "elapsed_seconds", "previous")


@q("wn_segment_fold", f"""SELECT result_id, sequence_no, CASE WHEN elapsed_seconds >= l THEN elapsed_seconds - l END AS segment, CASE WHEN distance_km > a THEN distance_km - a END AS segment_km,
 CASE WHEN elapsed_seconds > l THEN (elapsed_seconds - l) / (distance_km - a) END AS pace FROM (SELECT *, coalesce(last_value(elapsed_seconds IGNORE NULLS) {PRE}, 0) AS l, coalesce(lag(distance_km) {W}, 0) AS a FROM g)""", g=GAPPED)
def wn_segment_fold(m: Model) -> DataFrame:
    return op.fold_segments(gapped(m)).select("result_id", "sequence_no", "segment", "segment_km", "pace")


@q("wn_segment_strict", f"SELECT result_id, sequence_no, CASE WHEN sequence_no = coalesce(lag(sequence_no) {W}, 0) + 1 THEN elapsed_seconds - coalesce(lag(elapsed_seconds) {W}, 0) END AS segment FROM g", g=GAPPED)
def wn_segment_strict(m: Model) -> DataFrame:
    return op.strict_segments(gapped(m)).select("result_id", "sequence_no", "segment")


@q("wn_class_rank", """SELECT s.result_id, s.sequence_no, CASE WHEN s.result_id % 6 = 0 THEN s.place_overall WHEN e = 0 THEN rank() OVER (PARTITION BY s.race_id, c.age_class, s.sequence_no, e ORDER BY s.elapsed_seconds) END AS place_class
 FROM (SELECT *, CASE WHEN result_id % 10 = 0 THEN 1 ELSE 0 END AS e FROM splits) s JOIN c2 c ON c.id = s.result_id""")
def wn_class_rank(m: Model) -> DataFrame:
    classes = m.results.select(F.col("id").alias("result_id"), "age_class")
    rows = m.placed_splits.join(classes, "result_id").withColumns({"is_estimated": (F.col("result_id") % 10 == 0).cast("int"), "place_class": F.when(F.col("result_id") % 6 == 0, F.col("place_overall"))})
    return op.class_places(rows).select("result_id", "sequence_no", "place_class")


@q("wn_sm_index", "SELECT id, idx FROM ix", ix=INDEX)
def wn_sm_index(m: Model) -> DataFrame:
    return op.class_scores(finished(m)).select("id", "idx")


@q("wn_class_index", """SELECT race_id, nclass, id AS winner, 100.0::DOUBLE * (m - finish_seconds) / m AS dominance, nx - finish_seconds AS margin, n AS runners, n >= 5 AS eligible FROM (SELECT *, row_number() OVER o AS i, lead(finish_seconds) OVER o AS nx, count(*) OVER p AS n, median(finish_seconds) OVER p AS m FROM c2 WHERE category = 'finished'
 WINDOW p AS (PARTITION BY race_id, nclass), o AS (PARTITION BY race_id, nclass ORDER BY finish_seconds, id)) WHERE i = 1""")
def wn_class_index(m: Model) -> DataFrame:
    return op.dominance(finished(m))


CHANGES = f"SELECT race_id, result_id, arg_min(place_overall, sequence_no) - arg_max(place_overall, sequence_no) AS total, max(step) AS best FROM (SELECT *, lag(place_overall) {W} - place_overall AS step FROM splits) GROUP BY 1, 2"


@q("wn_overtakes", f"SELECT race_id, result_id, total, best, nth FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY total DESC, best DESC, result_id) AS nth FROM ({CHANGES}) WHERE total > 0 AND best > 0) WHERE nth <= 7")
def wn_overtakes(m: Model) -> DataFrame:
    return op.overtakes(m.placed_splits).select("race_id", "result_id", "total", "best", "nth")


@q("wn_closing_gain", "SELECT result_id, gain FROM gain")
def wn_closing_gain(m: Model) -> DataFrame:
    return op.closing_gain(m.placed_splits, MID)


CHARGE = f"SELECT result_id, max(CASE WHEN sequence_no = {MID} THEN place_overall END) - max(CASE WHEN sequence_no = {LAST} THEN place_overall END) AS won FROM splits GROUP BY 1"


@q("wn_chargers", f"SELECT sex, id, won, nth FROM (SELECT sex, id, won, row_number() OVER (PARTITION BY sex ORDER BY won DESC, id) AS nth FROM c2 JOIN ({CHARGE}) ON result_id = id WHERE won > 0) WHERE nth <= 5")
def wn_chargers(m: Model) -> DataFrame:
    won = op.between_controls(m.placed_splits, MID, LAST).select(F.col("result_id").alias("id"), "won")
    rows = people(m).select("id", "sex").join(won, "id").filter("won > 0")
    return op.top_per_group(rows, 5, ["sex"], F.desc("won"), F.col("id")).select("sex", "id", "won", "nth")


CAREER = "SELECT athlete_id, sex, count(*) AS finishes, min(finish_seconds) AS best, arg_min(finish_seconds, (year, id)) - arg_max(finish_seconds, (year, id)) AS improvement, max(finish_seconds) - min(finish_seconds) AS spread FROM c2 WHERE category = 'finished' GROUP BY 1, 2"


def _hall(m: Model, rows: str, *order: F.Column) -> DataFrame:
    return op.top_per_group(op.careers(finished(m)).filter(rows), 5, ["sex"], *order, F.col("athlete_id"))


@q("wn_hall_veterans", f"SELECT sex, athlete_id, finishes, nth FROM (SELECT *, row_number() OVER (PARTITION BY sex ORDER BY finishes DESC, athlete_id) AS nth FROM ({CAREER}) WHERE finishes > 1) WHERE nth <= 5")
def wn_hall_veterans(m: Model) -> DataFrame:
    return _hall(m, "finishes > 1", F.desc("finishes")).select("sex", "athlete_id", "finishes", "nth")


@q("wn_hall_improved", f"SELECT sex, athlete_id, improvement, nth FROM (SELECT *, row_number() OVER (PARTITION BY sex ORDER BY improvement DESC, athlete_id) AS nth FROM ({CAREER}) WHERE improvement > 0) WHERE nth <= 5")
def wn_hall_improved(m: Model) -> DataFrame:
    return _hall(m, "improvement > 0", F.desc("improvement")).select("sex", "athlete_id", "improvement", "nth")


@q("wn_hall_consistent", f"SELECT sex, athlete_id, spread, nth FROM (SELECT *, row_number() OVER (PARTITION BY sex ORDER BY spread, athlete_id) AS nth FROM ({CAREER}) WHERE finishes >= 3) WHERE nth <= 5")
def wn_hall_consistent(m: Model) -> DataFrame:
    return _hall(m, "finishes >= 3", F.asc("spread")).select("sex", "athlete_id", "spread", "nth")


@q("wn_history", "SELECT id, athlete_id, year, finish_seconds, min(finish_seconds) OVER (PARTITION BY athlete_id ORDER BY year, id ROWS UNBOUNDED PRECEDING) AS best_so_far, lag(finish_seconds) OVER (PARTITION BY athlete_id ORDER BY year, id) - finish_seconds AS improvement FROM c2 WHERE category = 'finished'")
def wn_history(m: Model) -> DataFrame:
    w = Window.partitionBy("athlete_id").orderBy("year", "id")
    return finished(m).select("id", "athlete_id", "year", "finish_seconds", F.min("finish_seconds").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("best_so_far"), (F.lag("finish_seconds").over(w) - F.col("finish_seconds")).alias("improvement"))


@q("wn_segment_lab", """SELECT race_id, result_id, seconds, won, nth FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY seconds, result_id) AS nth FROM (SELECT race_id, result_id, max(CASE WHEN sequence_no = 6 THEN elapsed_seconds END) - max(CASE WHEN sequence_no = 2 THEN elapsed_seconds END) AS seconds,
 max(CASE WHEN sequence_no = 2 THEN place_overall END) - max(CASE WHEN sequence_no = 6 THEN place_overall END) AS won FROM splits GROUP BY 1, 2) WHERE seconds > 0) WHERE nth <= 12""")
def wn_segment_lab(m: Model) -> DataFrame:
    rows = op.between_controls(m.placed_splits, 2, 6)
    return op.top_per_group(rows, 12, ["race_id"], F.col("seconds"), F.col("result_id")).select("race_id", "result_id", "seconds", "won", "nth")


@q("wn_club_rank", f"""SELECT ranking, clubkey, nth FROM (SELECT 'median' AS ranking, clubkey, row_number() OVER (ORDER BY median, clubkey) AS nth FROM ({CLUBS}) WHERE starters >= 5 AND median IS NOT NULL UNION ALL
 SELECT 'starters', clubkey, row_number() OVER (ORDER BY starters DESC, clubkey) FROM ({CLUBS}) UNION ALL SELECT 'finishers', clubkey, row_number() OVER (ORDER BY finishers DESC, clubkey) FROM ({CLUBS}) UNION ALL
 SELECT 'index', clubkey, row_number() OVER (ORDER BY idx DESC, clubkey) FROM ({CLUBS}) WHERE idx IS NOT NULL) WHERE nth <= 12""", ix=INDEX)
def wn_club_rank(m: Model) -> DataFrame:
    c = clubs(m)
    of = lambda name, v: F.struct(F.lit(name).alias("ranking"), v.cast("double").alias("v"))
    all_rankings = F.array(of("median", F.when(F.col("starters") >= 5, -F.col("median"))), *(of(name, F.col(c_)) for name, c_ in (("starters", "starters"), ("finishers", "finishers"), ("index", "idx"))))
    rows = c.select("clubkey", F.explode(all_rankings).alias("x")).select("clubkey", "x.ranking", "x.v").filter("v is not null")
    return op.top_per_group(rows, 12, ["ranking"], F.desc("v"), F.col("clubkey")).select("ranking", "clubkey", "nth")


@q("wn_rank_change", f"SELECT result_id, sequence_no, lag(place_overall) {W} - place_overall AS won FROM splits")
def wn_rank_change(m: Model) -> DataFrame:
    return m.placed_splits.select("result_id", "sequence_no", (F.lag("place_overall").over(op.along()) - F.col("place_overall")).alias("won"))


@q("wn_pace_color", "SELECT result_id, sequence_no, CASE WHEN n > 1 THEN floor((l + greatest(0, e - 1) / 2.0::DOUBLE) / (n - 1) * 4 + 0.5)::BIGINT ELSE 2 END AS bin FROM (SELECT *, rank() OVER (PARTITION BY race_id, sequence_no ORDER BY pace) - 1 AS l, count(*) OVER (PARTITION BY race_id, sequence_no, pace) AS e, count(*) OVER (PARTITION BY race_id, sequence_no) AS n FROM seg)")
def wn_pace_color(m: Model) -> DataFrame:
    return segments(m).withColumn("bin", op.mid_rank_bin("pace", "race_id", "sequence_no").cast("long")).select("result_id", "sequence_no", "bin")


@q("wn_bubble_lag", f"SELECT nclass, year, participants - lag(participants) OVER w AS d_participants, kmh - lag(kmh) OVER w AS d_kmh, median - lag(median) OVER w AS d_median FROM ({EVOLUTION}) WINDOW w AS (PARTITION BY nclass ORDER BY year)")
def wn_bubble_lag(m: Model) -> DataFrame:
    w = Window.partitionBy("nclass").orderBy("year")
    change = lambda c: (F.col(c) - F.lag(c).over(w)).alias(f"d_{c}")
    return evolution(m).select("nclass", "year", change("participants"), change("kmh"), change("median"))


ISSUES = f"""SELECT result_id, sequence_no, code, CASE WHEN code = 'segment_gap' THEN 'warning' ELSE 'error' END AS severity FROM (SELECT *, unnest([CASE WHEN elapsed_seconds <= 0 THEN 'non_positive' END, CASE WHEN elapsed_seconds <= b THEN 'not_increasing' END, CASE WHEN elapsed_seconds > finish_seconds THEN 'after_finish' END,
 CASE WHEN segment_seconds <> elapsed_seconds - coalesce(b, 0) THEN CASE WHEN sequence_no = coalesce(n, 0) + 1 THEN 'segment_mismatch' ELSE 'segment_gap' END END]) AS code FROM (SELECT g.*, c.finish_seconds, lag(g.elapsed_seconds) OVER (PARTITION BY result_id ORDER BY sequence_no) AS b, lag(sequence_no) {W} AS n FROM g LEFT JOIN c2 c ON c.id = result_id)) WHERE code IS NOT NULL"""


@q("wn_seq_issues", ISSUES, g=GAPPED)
def wn_seq_issues(m: Model) -> DataFrame:
    return sequence_issues(gapped(m), m.results)


@q("so_results", "SELECT id, row_number() OVER (ORDER BY race_id, coalesce(nullif(overall_place, 0), 999999), coalesce(nullif(finish_seconds, 0), 999999999), id) AS nth FROM results WHERE race_id = 19970")
def so_results(m: Model) -> DataFrame:
    big = lambda c, v: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(v))
    order = [F.col("race_id"), big("overall_place", 999_999), big("finish_seconds", 999_999_999), F.col("id")]
    return m.placed_results.filter("race_id = 19970").select("id", F.row_number().over(Window.partitionBy("race_id").orderBy(*order)).alias("nth"))


@q("so_class", "SELECT age_class, row_number() OVER (ORDER BY CASE WHEN left(nclass, 1) = 'W' THEN 0 ELSE 1 END, substr(nclass, 2)::INT, age_class) AS nth FROM (SELECT DISTINCT age_class, nclass FROM c2)")
def so_class(m: Model) -> DataFrame:
    keys = class_order(F.col("age_class"))
    return m.results.select("age_class").distinct().select("age_class", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys, "age_class")).alias("nth"))


@q("so_swedish", "SELECT c_name AS name FROM customer")
def so_swedish(m: Model) -> DataFrame:
    return m.athletes.select("name").orderBy(F.collate("name", "sv"))


@q("so_topk_group", "SELECT race_id, sex, id, nth FROM (SELECT *, row_number() OVER (PARTITION BY race_id, sex ORDER BY finish_seconds, id) AS nth FROM c2 WHERE category = 'finished') WHERE nth <= 5")
def so_topk_group(m: Model) -> DataFrame:
    return op.top_per_group(finished(m), 5, ["race_id", "sex"], F.col("finish_seconds"), F.col("id")).select("race_id", "sex", "id", "nth")


@q("so_podium", "SELECT race_id, id, [2, 1, 3][nth]::BIGINT AS step FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY finish_seconds, id) AS nth FROM c2 WHERE category = 'finished') WHERE nth <= 3")
def so_podium(m: Model) -> DataFrame:
    top = op.top_per_group(finished(m), 3, ["race_id"], F.col("finish_seconds"), F.col("id"))
    return top.select("race_id", "id", F.get(F.array(F.lit(2), F.lit(1), F.lit(3)), F.col("nth") - 1).alias("step"))
