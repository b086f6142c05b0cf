"""Reading result pages, tables, JSON feeds and tracks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempotrail.functions.text import clean, normalised, plain, seconds

# fixed values: the spellings of columns by field
ALIASES = {
    "name": ("namn", "name", "runner", "deltagare"),
    "bib": ("startnummer", "startnr", "bib", "nr"),
    "club": ("klubb", "club", "forening"),
    "age_class": ("klass", "class", "age class"),
    "finish": ("sluttid", "finish time", "finish", "tid"),
    "status": ("status",),
}
LEAST_PART = 6
DELIMITERS = ";,\t|"
SNIFF_CHARS = 8192
PAGE_BLOCK = 1024


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Races of a JSON file with nested checkpoints, a row a control."""
    races = spark.read.option("multiLine", True).json(path)
    if "races" in races.columns:
        races = races.select(F.explode("races").alias("r")).select("r.*")
    return races.select("*", F.posexplode_outer("checkpoints").alias("_no", "_c")).select(*(c for c in races.columns if c != "checkpoints"), F.col("_no").alias("sequence_no"), F.col("_c").alias("checkpoint"))


def delimiter(sample: str) -> str:
    """The separator that splits the first lines most evenly; a semicolon if none does."""
    lines = [x for x in sample[:SNIFF_CHARS].splitlines() if x.strip()][:20]
    best, most = ";", 0
    for d in DELIMITERS:
        counts = [x.count(d) for x in lines]
        if counts and min(counts) > 0 and min(counts) == max(counts) and counts[0] > most:
            best, most = d, counts[0]
    return best


def flexible_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", sep: str | None = None) -> DataFrame:
    """A CSV file with a header, whatever separates its columns (found by its first lines)."""
    lines = [] if sep else spark.read.option("encoding", encoding).csv(path, sep="\u0001", quote="").limit(20).collect()
    head = "\n".join(r[0].removeprefix("\ufeff") for r in lines if r[0])
    return spark.read.option("header", True).option("sep", sep or delimiter(head)).option("encoding", encoding).csv(path)


def header_map(columns: Sequence[str], checkpoints: Sequence[str] = (), explicit: dict[str, str] | None = None) -> dict[str, str]:
    """Column to field: as told, as a checkpoint (split:key), as an alias, or as part of a long one."""
    key = lambda x: re.sub(r"[^a-z0-9]+", " ", plain(x).lower()).strip()
    out: dict[str, str] = {}
    controls = {key(c): f"split:{c}" for c in checkpoints}
    for column in columns:
        name = key(column)
        if explicit and column in explicit:
            out[column] = explicit[column]
        elif name in controls:
            out[column] = controls[name]
        else:
            exact = next((f for f, names in ALIASES.items() if name in names), None)
            part = next((f for f, names in ALIASES.items() if any(len(a) >= LEAST_PART and a in name for a in names)), None)
            if exact or part:
                out[column] = exact or part
    return out


def mapped(rows: DataFrame, mapping: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Results with a source id (the bib, else a hash of the row's content and its number among equal rows), and passages in long form."""
    first = {}
    for column, field in mapping.items():
        first.setdefault(field, column)
    fields = {f: clean(F.col(c)) for f, c in first.items() if not f.startswith("split:")}
    bib = fields.get("bib", F.lit(None).cast("string"))
    digest = F.sha1(F.to_json(F.struct(*rows.columns)))
    # the same file has the same ids however it is read: equal rows differ by their number alone
    without = rows.filter(bib.isNull()).withColumn("_digest", digest)
    nth = F.row_number().over(Window.partitionBy("_digest").orderBy("_digest"))
    without = without.withColumn("_id", F.left(F.sha1(F.concat_ws("|", "_digest", nth.cast("string"))), F.lit(16))).drop("_digest")
    numbered = rows.filter(bib.isNotNull()).withColumn("_id", bib).unionByName(without)
    source_id = F.col("_id")
    results = numbered.select(source_id.alias("source_id"), *(v.alias(k) for k, v in fields.items()))
    splits = {f.removeprefix("split:"): c for f, c in first.items() if f.startswith("split:")}
    if not splits:
        return results, numbered.select(source_id.alias("source_id"), F.lit("").alias("checkpoint_key"), F.lit(0).alias("elapsed_seconds")).limit(0)
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("checkpoint_key"), seconds(F.col(c)).alias("elapsed_seconds")) for k, c in splits.items())))
    long = numbered.select(source_id.alias("source_id"), pairs.alias("p")).select("source_id", "p.*").filter("elapsed_seconds is not null")
    return results, long


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """The distinct link targets of pages."""
    found = F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), F.lit(1))
    return pages.select(F.explode(F.transform(found, lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))).alias("href")).distinct()


def participants(pages: DataFrame) -> DataFrame:
    """idp of each link in pages, once."""
    return links(pages).select(F.regexp_extract("href", r"[?&]idp=([^&#]+)", 1).alias("idp")).filter("idp <> ''").distinct()


def tag_text(html: Column, tag: str) -> Column:
    """The text of every such element without inner tags."""
    inner = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.transform(inner, lambda x: clean(F.regexp_replace(x, r"<[^>]+>", " ")))


def by_class(html: Column, names: Sequence[str]) -> Column:
    """The text of the first element with one of the classes that isn't empty; of a table row the second cell."""
    def one(name: str) -> Column:
        row = F.regexp_extract(html, rf'(?is)<tr\b[^>]*class="[^"]*\b{name}\b[^"]*"[^>]*>(.*?)</tr>', 1)
        cells = tag_text(row, "t[dh]")
        other = F.regexp_extract(html, rf'(?is)<(?!tr\b)\w+\b[^>]*class="[^"]*\b{name}\b[^"]*"[^>]*>(.*?)</', 1)
        return F.coalesce(F.get(cells, 1), clean(F.regexp_replace(other, r"<[^>]+>", " ")))

    return F.coalesce(*(one(n) for n in names))


def labelled_cells(html: Column) -> Column:
    """label and value of rows of two cells and of dt/dd pairs, as a map; the first of a label counts."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    pairs = F.filter(F.transform(rows, lambda r: tag_text(r, "t[dh]")), lambda c: F.size(c) == 2)
    lists = F.zip_with(tag_text(html, "dt"), tag_text(html, "dd"), lambda a, b: F.array(a, b))
    every = F.filter(F.concat(pairs, lists), lambda c: F.get(c, 0).isNotNull())
    return F.transform(every, lambda c: F.struct(normalised(F.get(c, 0)).alias("label"), F.get(c, 1).alias("value")))


def split_rows(html: Column) -> Column:
    """The cells of each table row of class split that isn't estimated."""
    rows = F.regexp_extract_all(html, F.lit(r'(?is)(<tr\b[^>]*class="[^"]*\bsplit\b[^"]*"[^>]*>.*?</tr>)'), F.lit(1))
    real = F.filter(rows, lambda r: ~r.rlike(r'(?is)^<tr\b[^>]*class="[^"]*\bestimated\b'))
    return F.transform(real, lambda r: tag_text(r, "t[dh]"))


def events(pages: DataFrame) -> DataFrame:
    """code, label, year of the options that name a race; the year of the group, else the text, else the path."""
    groups = F.regexp_extract_all("html", F.lit(r'(?is)(<optgroup\b.*?</optgroup>)'), F.lit(1))
    g = pages.select("path_year", F.explode(groups).alias("g"))
    options = F.regexp_extract_all("g", F.lit(r'(?is)(<option\b.*?</option>)'), F.lit(1))
    o = g.select("path_year", F.regexp_extract("g", r'(?is)label="[^"]*?(\d{4})', 1).alias("group_year"), F.explode(options).alias("o"))
    label = clean(F.regexp_replace("o", r"<[^>]+>", " "))
    year = F.coalesce(F.nullif(F.col("group_year"), F.lit("")), F.nullif(F.regexp_extract(label, r"(20\d\d)", 1), F.lit("")), F.col("path_year").cast("string")).cast("int")
    return o.select(F.regexp_extract("o", r'value="([^"]*)"', 1).alias("code"), label.alias("label"), year.alias("year")).filter(F.col("label").rlike("45|90"))


def paginate(entries: DataFrame, stop_after: int = 2) -> DataFrame:
    """entries (page, pos, id): each id where it comes first, up to the run of pages that bring nothing new.

    Runs are counted inside blocks of pages; what a block ends with is carried over blocks, a row each.
    """
    first = entries.groupBy("id").agg(F.min(F.struct("page", "pos")).alias("_at")).select("id", "_at.page", "_at.pos")
    fresh = first.groupBy("page").agg(F.count("*").alias("fresh"))
    pages = entries.select("page").distinct().join(fresh, "page", "left").withColumn("_block", F.floor(F.col("page") / PAGE_BLOCK))
    upto = Window.partitionBy("_block").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    pages = pages.withColumn("_pos", F.count("*").over(upto)).withColumn("_full", F.max(F.when(F.col("fresh") > 0, F.col("_pos"))).over(upto))
    blocks = pages.groupBy("_block").agg((F.max("_pos") - F.coalesce(F.max("_full"), F.lit(0))).alias("_tail"), F.max("_full").isNull().alias("_empty"))
    over = Window.partitionBy(F.lit(0)).orderBy("_block")  # a row a block
    blocks = blocks.withColumn("_run", F.sum((~F.col("_empty")).cast("int")).over(over))
    blocks = blocks.withColumn("_upto", F.sum("_tail").over(Window.partitionBy("_run").orderBy("_block"))).withColumn("_carry", F.coalesce(F.lag("_upto").over(over), F.lit(0)))
    run = F.col("_pos") - F.coalesce("_full", F.lit(0)) + F.when(F.col("_full").isNull(), F.col("_carry")).otherwise(0)
    stop = pages.join(blocks.select("_block", "_carry"), "_block").filter(run >= stop_after).agg(F.min("page").alias("_stop"))
    return first.join(F.broadcast(stop), how="cross").filter("_stop is null or page <= _stop").drop("_stop")  # a single row


def decoded(records: DataFrame, keys: dict[str, str], column: str = "record") -> DataFrame:
    """A map column with its compact keys spelled out."""
    names = F.create_map(*(F.lit(x) for pair in keys.items() for x in pair))
    return records.withColumn(column, F.transform_keys(column, lambda k, v: F.coalesce(F.element_at(names, k), k)))


def nested(rows: DataFrame) -> DataFrame:
    """One record a runner from rows (year, external_id, name, bib, control, elapsed_seconds)."""
    key = F.concat_ws("|", F.col("year").cast("string"), F.coalesce("external_id", F.concat_ws("|", normalised(F.col("name")), F.col("bib"))))
    parts = F.array_sort(F.collect_list(F.struct("elapsed_seconds", "control")))
    return rows.groupBy(key.alias("key")).agg(F.min("name").alias("name"), F.max("elapsed_seconds").alias("finish_seconds"), parts.alias("splits"))


def unpivoted(rows: DataFrame, key: str, suffix: str = "_tid") -> DataFrame:
    """Columns like c1_tid as rows of control and elapsed_seconds."""
    columns = [c for c in rows.columns if c.endswith(suffix)]
    long = rows.unpivot(key, columns, "control", "elapsed_seconds")
    return long.filter("elapsed_seconds is not null").withColumn("control", F.replace("control", F.lit(suffix), F.lit("")))


def exploded(records: DataFrame, key: str) -> DataFrame:
    """Passages of records with splits as a list of structs or a map by control."""
    kind = records.schema["splits"].dataType.typeName()
    if kind == "map":
        return records.select(key, F.explode("splits").alias("control", "elapsed_seconds"))
    return records.select(key, F.explode("splits").alias("s")).select(key, "s.control", "s.elapsed_seconds")


def wrapped_json(text: Column) -> Column:
    """The JSON inside a script, from its outermost bracket."""
    return F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1)


def track_points(text: Column) -> Column:
    """lat, lon, elev of the track or route points of a GPX text, whatever its namespace."""
    points = F.regexp_extract_all(text, F.lit(r"(?is)(<(?:\w+:)?(?:trkpt|rtept)\b.*?(?:/>|</(?:\w+:)?(?:trkpt|rtept)>))"), F.lit(1))
    value = lambda p, pattern: F.regexp_extract(p, pattern, 1).try_cast("double")
    return F.transform(points, lambda p: F.struct(value(p, r'\blat="([^"]+)"').alias("lat"), value(p, r'\blon="([^"]+)"').alias("lon"), value(p, r"(?i)<(?:\w+:)?ele>\s*([^<]+?)\s*<").alias("elev")))


def longest_line(kml: Column) -> Column:
    """lon, lat, elev of the longest coordinate list of a KML text."""
    lists = F.transform(F.regexp_extract_all(kml, F.lit(r"(?is)<coordinates>(.*?)</coordinates>"), F.lit(1)), lambda x: F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " "))
    ranked = F.array_sort(F.transform(lists, lambda x: F.struct((-F.size(x)).alias("n"), x.alias("x"))))
    part = lambda p, i: F.get(F.split(p, ","), i).try_cast("double")
    return F.transform(F.get(ranked, 0)["x"], lambda p: F.struct(part(p, 1).alias("lat"), part(p, 0).alias("lon"), part(p, 2).alias("elev")))


def tracks(spark: SparkSession, path: str) -> DataFrame:
    """Points (path, idx, lat, lon, elev) of GPX files, at least two a file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), track_points(F.col("value")).alias("points"))
    return files.filter(F.size("points") >= 2).select("path", F.posexplode("points").alias("idx", "p")).select("path", "idx", "p.*")


def archived_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Points of the longest line in KMZ archives; an archive without a KML file has none."""

    def unzipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    name = next((n for n in z.namelist() if n.lower().endswith(".kml")), None)
                    texts.append(z.read(name).decode("utf-8", "replace") if name else "")
            yield pd.DataFrame({"path": batch["path"], "kml": texts})

    kml = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unzipped, "path string, kml string")
    files = kml.select("path", longest_line(F.col("kml")).alias("points"))
    return files.filter(F.size("points") >= 2).select("path", F.posexplode("points").alias("idx", "p")).select("path", "idx", "p.*")
