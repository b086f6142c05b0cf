"""Race data derived from the generic tables, once as DataFrames and once as SQL.

A customer is an athlete, an order a result, a line item a passage, a year and family a race.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempotrail.operators.windows import ranked

CONTROLS = 8
#: The control from which late gains count, and the last one.
MID, LAST = 4, 8


class Model:
    """The tables of the race model over one folder of parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def _orders(self) -> DataFrame:
        short = F.col("o_orderkey") % 4 == 0
        year = F.year("o_orderdate")
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("athlete_id"), F.col("o_orderstatus").alias("letter"), "o_orderdate",
            year.alias("year"), (year * 10 + short.cast("int")).alias("race_id"), F.when(short, "short").otherwise("long").alias("family"),
            F.when(short, 45.0).when(year < 1998, 90.0).otherwise(92.0).alias("distance_km"), F.when(year < 1998, "pre").otherwise("post").alias("era"),
        )

    @cached_property
    def races(self) -> DataFrame:
        return self._orders.select("race_id", F.concat_ws("-", "family", "year").alias("race_key"), "family", "year", "distance_km", "era").distinct()

    @cached_property
    def athletes(self) -> DataFrame:
        c = F.col("c_custkey")
        segment = F.when(c % 3 == 0, F.upper("c_mktsegment")).when(c % 3 == 1, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
        club = F.when(c % 7 != 0, F.when(c % 5 == 0, F.concat(segment, F.lit(" IF"))).otherwise(segment))
        nation = self.table("nation").select("n_nationkey", F.col("n_name").alias("nationality"))
        sex = F.when(c % 50 == 0, "U").when(c % 2 == 0, "M").otherwise("F")
        return self.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(c.alias("athlete_id"), F.col("c_name").alias("name"), sex.alias("sex"), "nationality", club.alias("club"))

    @cached_property
    def _passages(self) -> DataFrame:
        """The first line items of an order, numbered by time."""
        order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey")
        rows = self.table("lineitem").withColumn("sequence_no", F.row_number().over(order)).filter(F.col("sequence_no") <= CONTROLS)
        return rows.withColumn("segment_seconds", F.col("l_quantity").cast("long") * 60)

    @cached_property
    def splits(self) -> DataFrame:
        """result_id, race_id, sequence_no, checkpoint_key, segment_seconds, elapsed_seconds, distance_km."""
        along = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey").rowsBetween(Window.unboundedPreceding, 0)
        out = self._passages.withColumn("elapsed_seconds", F.sum("segment_seconds").over(along))
        out = out.join(self._orders.select("id", "race_id", "family"), F.col("l_orderkey") == F.col("id"))
        km = F.when(F.col("family") == "short", 5.625).otherwise(11.25) * F.col("sequence_no")
        return out.select(F.col("id").alias("result_id"), "race_id", "sequence_no", F.concat(F.lit("c"), F.col("sequence_no")).alias("checkpoint_key"), "segment_seconds", "elapsed_seconds", km.alias("distance_km"))

    @cached_property
    def placed_splits(self) -> DataFrame:
        """splits with place_overall at the control."""
        return ranked(self.splits, ["race_id", "sequence_no"], "elapsed_seconds", "place_overall")

    @cached_property
    def checkpoints(self) -> DataFrame:
        steps = self.races.select("race_id", "family", F.explode(F.sequence(F.lit(0), F.lit(CONTROLS))).alias("sequence_no"))
        km = F.when(F.col("family") == "short", 5.625).otherwise(11.25) * F.col("sequence_no")
        return steps.select("race_id", F.concat(F.lit("c"), F.col("sequence_no")).alias("checkpoint_key"), F.concat(F.lit("Control "), F.col("sequence_no")).alias("name"), "sequence_no", km.alias("distance_km"))

    @cached_property
    def evidenced(self) -> DataFrame:
        """results with has_split: whether a passage with a time was seen."""
        o, i = F.col("letter"), F.col("id")
        last = self._passages.groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("segment_seconds").alias("last_elapsed"), (F.max("segment_seconds") > 0).alias("seen"))
        status = F.when(o == "F", "FINISHED").when(o == "P", F.when(i % 3 == 0, "DNF").when(i % 3 == 1, "STARTAT").otherwise("")).otherwise(F.when(i % 3 == 0, "DNS").when(i % 3 == 1, "DSQ").otherwise("FINISHED"))
        prefix = F.when(F.col("sex") == "F", F.when(F.col("year") < 1998, "D").otherwise("W")).otherwise(F.when(F.col("year") < 1998, "H").otherwise("M"))
        out = self._orders.join(last, "id", "left").join(self.athletes, "athlete_id")
        out = out.withColumns({"status": status, "has_split": F.coalesce("seen", F.lit(False))})
        return out.select(
            "id", "race_id", "athlete_id", "name", "sex", F.concat(prefix, (20 + 5 * (F.col("athlete_id") % 9)).cast("string")).alias("age_class"), "club", "nationality",
            (i % 997).cast("string").alias("bib"), "status", F.when((F.col("status") == "FINISHED") | (i % 11 == 0), F.col("last_elapsed")).alias("finish_seconds"), "family", "year", "distance_km", "era", "has_split",
        )

    @cached_property
    def results(self) -> DataFrame:
        """id, race_id, athlete_id, name, sex, age_class, club, nationality, bib, status, finish_seconds, and the race's columns."""
        return self.evidenced.drop("has_split")

    @cached_property
    def placed_results(self) -> DataFrame:
        """results with overall_place, null without a finish."""
        return ranked(self.results, ["race_id"], "finish_seconds", "overall_place")

    @cached_property
    def sources(self) -> DataFrame:
        """Results of two sources by priority, with gaps."""
        base = self.results.select("race_id", "athlete_id", "id", "status", "finish_seconds", "age_class")
        first = base.filter(F.col("id") % 3 != 0).withColumn("priority", F.lit(0))
        second = base.select("race_id", "athlete_id", "id", F.when(F.col("id") % 7 == 0, "UNKNOWN").otherwise(F.col("status")).alias("status"), F.when(F.col("id") % 5 != 0, F.col("finish_seconds")).alias("finish_seconds"), F.when(F.col("id") % 4 == 0, "").otherwise(F.col("age_class")).alias("age_class"), F.lit(2).alias("priority"))
        return first.unionByName(second)


VIEWS = {
    "o": """SELECT o_orderkey AS id, o_custkey AS athlete_id, o_orderstatus AS letter, o_orderdate, year(o_orderdate) AS year,
        year(o_orderdate) * 10 + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS race_id, CASE WHEN o_orderkey % 4 = 0 THEN 'short' ELSE 'long' END AS family,
        CASE WHEN o_orderkey % 4 = 0 THEN 45.0::DOUBLE WHEN year(o_orderdate) < 1998 THEN 90.0::DOUBLE ELSE 92.0::DOUBLE END AS distance_km,
        CASE WHEN year(o_orderdate) < 1998 THEN 'pre' ELSE 'post' END AS era FROM orders""",
    "races": "SELECT DISTINCT race_id, family || '-' || year AS race_key, family, year, distance_km, era FROM o",
    "athletes": """SELECT c_custkey AS athlete_id, c_name AS name, CASE WHEN c_custkey % 50 = 0 THEN 'U' WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex, n_name AS nationality,
        CASE WHEN c_custkey % 7 <> 0 THEN (CASE c_custkey % 3 WHEN 0 THEN upper(c_mktsegment) WHEN 1 THEN lower(c_mktsegment) ELSE c_mktsegment END) || CASE WHEN c_custkey % 5 = 0 THEN ' IF' ELSE '' END END AS club
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "splits": """SELECT result_id, race_id, sequence_no, 'c' || sequence_no AS checkpoint_key, segment_seconds, elapsed_seconds,
        CASE WHEN family = 'short' THEN 5.625::DOUBLE ELSE 11.25::DOUBLE END * sequence_no AS distance_km, rank() OVER (PARTITION BY race_id, sequence_no ORDER BY elapsed_seconds) AS place_overall
        FROM (SELECT o.id AS result_id, o.race_id, o.family, n AS sequence_no, q AS segment_seconds, (sum(q) OVER (PARTITION BY l_orderkey ORDER BY n))::BIGINT AS elapsed_seconds
              FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey) AS n, l_quantity::BIGINT * 60 AS q FROM lineitem) JOIN o ON l_orderkey = o.id WHERE n <= 8)""",
    "checkpoints": """SELECT race_id, 'c' || n AS checkpoint_key, 'Control ' || n AS name, n AS sequence_no, CASE WHEN family = 'short' THEN 5.625::DOUBLE ELSE 11.25::DOUBLE END * n AS distance_km FROM races, range(9) t(n)""",
    "results": """SELECT *, CASE WHEN finish_seconds IS NOT NULL THEN rank() OVER (PARTITION BY race_id ORDER BY finish_seconds NULLS LAST) END AS overall_place FROM (
        SELECT id, race_id, athlete_id, name, sex, CASE WHEN sex = 'F' THEN CASE WHEN year < 1998 THEN 'D' ELSE 'W' END ELSE CASE WHEN year < 1998 THEN 'H' ELSE 'M' END END || (20 + 5 * (athlete_id % 9)) AS age_class,
               club, nationality, CAST(id % 997 AS VARCHAR) AS bib, status, CASE WHEN status = 'FINISHED' OR id % 11 = 0 THEN last_elapsed END AS finish_seconds, family, year, distance_km, era
        FROM (SELECT o.*, a.name, a.sex, a.club, a.nationality, l.last_elapsed, CASE letter WHEN 'F' THEN 'FINISHED' WHEN 'P' THEN CASE id % 3 WHEN 0 THEN 'DNF' WHEN 1 THEN 'STARTAT' ELSE '' END ELSE CASE id % 3 WHEN 0 THEN 'DNS' WHEN 1 THEN 'DSQ' ELSE 'FINISHED' END END AS status
              FROM o JOIN athletes a USING (athlete_id) LEFT JOIN (SELECT result_id, max(elapsed_seconds) AS last_elapsed FROM splits GROUP BY 1) l ON l.result_id = o.id))""",
    "sources": """SELECT race_id, athlete_id, id, status, finish_seconds, age_class, 0 AS priority FROM results WHERE id % 3 <> 0 UNION ALL
        SELECT race_id, athlete_id, id, CASE WHEN id % 7 = 0 THEN 'UNKNOWN' ELSE status END, CASE WHEN id % 5 <> 0 THEN finish_seconds END, CASE WHEN id % 4 = 0 THEN '' ELSE age_class END, 2 FROM results""",
    "ev": "SELECT DISTINCT result_id FROM splits WHERE elapsed_seconds > 0 OR segment_seconds > 0",
    "cls": """SELECT * EXCLUDE (kind), replace(kind, 'derived_', '') AS category, kind = 'derived_dnf' AS derived, finish_seconds > 0 AND s <> 'FINISHED' AS contradictory_finish,
        kind = 'dns' AND (coalesce(finish_seconds, 0) > 0 OR has_split) AS contradictory_dns FROM (SELECT r.*, e.result_id IS NOT NULL AS has_split,
        CASE WHEN s = 'DNS' THEN 'dns' WHEN s = 'DSQ' THEN 'dsq' WHEN s = 'FINISHED' AND finish_seconds > 0 THEN 'finished' WHEN s = 'DNF' THEN 'dnf'
             WHEN s IN ('STARTAT', 'FINISHED') OR e.result_id IS NOT NULL OR finish_seconds > 0 THEN 'derived_dnf' ELSE 'unknown' END AS kind
        FROM (SELECT *, upper(trim(coalesce(status, ''))) AS s FROM results) r LEFT JOIN ev e ON e.result_id = r.id)""",
}


def sql(body: str, **more: str) -> str:
    """The body with the views of the model before it."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in (VIEWS | more).items()) + "\n" + body
