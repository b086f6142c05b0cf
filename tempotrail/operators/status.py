"""What became of a starter: one classifier for all statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempotrail.functions.text import clean, normalised, optional

# fixed values: status words
FINISHED = ("FINISHED", "FINISH", "OK", "GODKÄND", "GODKAND")
DNF = ("DNF", "BRUTIT", "DID NOT FINISH")
DNS = ("DNS", "EJ START", "EJ STARTAT", "STARTADE INTE", "DID NOT START")
DSQ = ("DSQ", "DISQUALIFIED", "DISKVALIFICERAD")
STARTED = ("STARTED", "STARTAT")


def plain(status: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(F.coalesce(status, F.lit("")))), r"\s+", " ")


def evidence(splits: DataFrame) -> DataFrame:
    """The results that were seen on the course: any passage with a time."""
    return splits.filter("result_id is not null and (elapsed_seconds > 0 or segment_seconds > 0)").select("result_id").distinct()


def classify(results: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """results (id, status, finish_seconds) with has_split, category, derived and the two contradictions.

    seen: the results of evidence(), unless has_split says so already.  DNS and DSQ hold whatever else is known; finished takes both the word and a time; whoever has started in
    any other way did not finish.
    """
    if seen is None:
        out = results if "has_split" in results.columns else results.withColumn("has_split", F.lit(False))
    else:
        out = results.join(seen.select(F.col("result_id").alias("_seen")), F.col("id") == F.col("_seen"), "left").withColumn("has_split", F.col("_seen").isNotNull()).drop("_seen")
    word, timed = plain(F.col("status")), F.coalesce(F.col("finish_seconds") > 0, F.lit(False))
    started = word.isin(*STARTED, *FINISHED) | F.col("has_split") | timed
    kind = F.when(word.isin(*DNS), "dns").when(word.isin(*DSQ), "dsq").when(word.isin(*FINISHED) & timed, "finished").when(word.isin(*DNF), "dnf").when(started, "derived").otherwise("unknown")
    out = out.withColumns({"_kind": kind, "contradictory_finish": timed & ~word.isin(*FINISHED), "contradictory_dns": word.isin(*DNS) & (timed | F.col("has_split"))})
    return out.withColumns({"category": F.when(F.col("_kind") == "derived", "dnf").otherwise(F.col("_kind")), "derived": F.col("_kind") == "derived"}).drop("_kind")


def started() -> Column:
    return F.col("category").isin("finished", "dnf", "dsq")


def rate(part: Column, whole: Column) -> Column:
    """Per cent with one decimal, halves up; null of nothing."""
    return F.when(whole > 0, F.floor(part / whole * 1000 + 0.5) / 10)


def summarize(classified: DataFrame, *by: str) -> DataFrame:
    """Counts and the finish rate of classified results, in all or by groups."""
    count = lambda c: F.count_if(F.col("category") == c)
    out = classified.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(started()).alias("starters"), count("finished").alias("finishers"), count("dnf").alias("dnf"), count("dns").alias("dns"), count("dsq").alias("dsq"),
        count("unknown").alias("unknown"), F.count_if("derived").alias("derived_dnf"), F.count_if(F.col("contradictory_finish") | F.col("contradictory_dns")).alias("contradictions"),
    )
    return out.withColumn("rate", rate(F.col("finishers"), F.col("starters")))


def imported_word(value: Column) -> Column:
    """A result page's status as one of five words, or the text in capitals; null for nothing."""
    text, n = clean(value), normalised(value)
    # fixed values: words of result pages
    return (
        F.when(n.isin("dnf", "brutit", "brot", "avbrutit") | n.contains("did not finish"), "DNF")
        .when(n.isin("dns", "ej start", "ej startat", "inte startat", "startade inte") | n.contains("did not start"), "DNS")
        .when(n.isin("startat", "started"), "UNKNOWN")
        .when(n.isin("dsq", "diskvalificerad") | n.contains("disqualified"), "DSQ")
        .when(n.isin("finished", "finisher", "i mal", "malgang"), "FINISHED").otherwise(F.upper(text))
    )


def feed_word(value: Column, finish: Column, has_splits: Column) -> Column:
    """The same for JSON feeds, where a finish time decides first."""
    n = normalised(value, "_")
    # fixed values: parts of the feeds' words
    return (
        F.when(finish.isNotNull() | n.isin("i_mal", "finished", "finish"), "FINISHED").when(n.rlike("startade_inte|dns|not_start"), "DNS").when(n.rlike("disk|dsq|disqual"), "DSQ")
        .when(n.rlike("brutit|dnf|not_finish") | (n == "startat") | has_splits, "DNF").otherwise(F.coalesce(F.upper(clean(value)), F.lit("UNKNOWN")))
    )


def sex(value: Column) -> Column:
    first = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(first.isin("M", "H"), "M").when(first.isin("F", "W", "K", "D"), "F").otherwise("U")


def sex_of(value: Column, age_class: Column) -> Column:
    """The given sex, or that of a class like H40 or D21."""
    # fixed values: words for men and women
    men, women = ("m", "h", "man", "male", "men", "herr", "herrar"), ("d", "f", "w", "k", "woman", "women", "female", "dam", "damer", "kvinna")
    word, group = normalised(optional(value)), normalised(optional(age_class))
    compact = F.replace(group, F.lit(" "), F.lit(""))
    return F.when(word.isin(*men), "M").when(word.isin(*women), "F").when(group.isin(*men) | compact.rlike(r"^[mh]\d"), "M").when(group.isin(*women) | compact.rlike(r"^[dkfw]\d"), "F")


def sex_category(value: Column) -> Column:
    word = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(word.isin("M", "H", "MAN"), "M").when(word.isin("F", "W", "K", "D", "KVINNA"), "F")
