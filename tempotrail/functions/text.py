"""Text functions: cleaning, parsing, formatting, ordering."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: spellings of nothing
PLACEHOLDERS = ("n a", "na", "saknas", "ej angivet", "unknown")
# fixed values: patterns of times, and marks of a club's name
CLOCK = r"(?<!\d)(?:(\d{1,2}):)?([0-5]?\d):([0-5]\d)(?!\d)"
DURATION = r"PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?"
CLUB_MARKS = r"(^|\s)(if|fk|sk|ok|ik|aik|team|club|klubb|forening)(\s|$)|loparklubb|friidrott|runacademy|running"


def clean(text: Column) -> Column:
    """White space collapsed and trimmed; null for nothing."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def plain(text: str) -> str:
    """Compatible characters in their plain form, without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """The characters that plain() turns into one ASCII letter or digit, and behind them those it removes; what the
    former become; and what characters become that make several, some of them such letters."""
    one, gone, several = {}, [], {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if not (unicodedata.decomposition(c) or unicodedata.combining(c)):
            continue
        if not (p := plain(c)):
            gone.append(c)
        elif re.search("[A-Za-z0-9]", p):
            (one if len(p) == 1 else several)[c] = p
    return "".join([*one, *gone]), "".join(one.values()), several


def unmarked(text: Column) -> Column:
    """plain() as far as letters and digits without marks are asked for; other characters may stay as they are."""
    old, new, several = _folds()
    spelled = F.from_json(F.lit(json.dumps(several)), "map<string, string>")  # one constant, quicker to plan than a map of columns
    long = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(spelled, c), c)), "")
    return F.translate(F.when(text.rlike(f"[{''.join(several)}]"), long).otherwise(text), old, new)


def normalised(text: Column, separator: str = " ") -> Column:
    """Lower-case letters and digits in runs, without marks, joined by the separator."""
    runs = F.regexp_replace(F.lower(unmarked(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", separator)
    return F.regexp_replace(runs, f"^{separator}+|{separator}+$", "")


def club(text: Column) -> Column:
    """A club's key: capitals without marks, usual words shortened, company and country words gone."""
    out = F.upper(unmarked(F.coalesce(text, F.lit(""))))
    # fixed values: words of club names and their short forms
    for word, short in (("&", " OCH "), (r"\bIDROTTSKLUBB\b", " IK "), (r"\bIDROTTSFORENING\b", " IF "), (r"\bFRIIDROTTSKLUBB\b", " FK "), (r"\b(AKTIEBOLAG|AB|SWEDEN|SVERIGE)\b", " ")):
        out = F.regexp_replace(out, word, short)
    return F.trim(F.regexp_replace(out, "[^A-Z0-9]+", " "))


def age_class(text: Column) -> Column:
    """H to M, D and K to W before a digit; Okänd for nothing."""
    out = F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))
    out = F.regexp_replace(F.regexp_replace(out, r"^H(?=\d)", "M"), r"^[DK](?=\d)", "W")
    return F.when(out == "", "Okänd").otherwise(out)


def class_order(text: Column) -> list[Column]:
    """Sort keys: women, men, others; age; the rest of the label."""
    label = age_class(text)
    sex = F.when(label.rlike(r"^W\d"), 0).when(label.rlike(r"^M\d"), 1).otherwise(2)
    age = F.regexp_extract(label, r"(\d+)", 1).try_cast("int")
    return [sex, F.coalesce(age, F.lit(9999)), F.regexp_replace(label, r"^\D*\d+", ""), label]


def seconds(text: Column) -> Column:
    """The first h:mm:ss or mm:ss in a text."""
    part = lambda i: F.regexp_extract(text, CLOCK, i).try_cast("int")
    return F.coalesce(part(1), F.lit(0)) * 3600 + part(2) * 60 + part(3)


def pace(text: Column) -> Column:
    p = r"(\d{1,2})[:.,](\d{2})"
    return F.regexp_extract(text, p, 1).try_cast("int") * 60 + F.regexp_extract(text, p, 2).try_cast("int")


def number(text: Column) -> Column:
    return F.replace(F.regexp_extract(F.replace(text, F.lit(" "), F.lit("")), r"(-?\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")


def signed_seconds(text: Column) -> Column:
    return seconds(text) * F.when(F.trim(text).startswith("-"), -1).otherwise(1)


def whole(text: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(text, r"\s+", ""), r"(\d+)", 1).try_cast("int")


def any_seconds(text: Column) -> Column:
    """A number of seconds (or milliseconds over a million) under 48 hours, a PT..H..M..S duration, or a clock text."""
    n = F.trim(text).try_cast("double")
    n = F.when(n > 1_000_000, n / 1000).otherwise(n)
    part = lambda i: F.coalesce(F.regexp_extract(text, DURATION, i).try_cast("int"), F.lit(0))
    return F.when(n.isNotNull(), F.when((n >= 0) & (n < 48 * 3600), F.bround(n))).when(text.rlike(DURATION), part(1) * 3600 + part(2) * 60 + part(3)).otherwise(seconds(text)).cast("long")


def optional(text: Column) -> Column:
    """Null for placeholders and for texts without a letter or digit."""
    value = clean(text)
    return F.when(value.rlike(r"[\p{L}\p{N}]") & ~normalised(value).isin(*PLACEHOLDERS), value)


def name_and_nation(text: Column) -> tuple[Column, Column]:
    """A name and the three letters in brackets behind it."""
    value = clean(text)
    nation = F.nullif(F.regexp_extract(value, r"\(([A-Za-z]{3})\)$", 1), F.lit(""))
    return F.trim(F.regexp_replace(value, r"\s*\([A-Za-z]{3}\)$", "")), F.upper(nation)


def nation_in(raw: Column) -> Column:
    """The nationality that a page's stored fields state, or the published name's suffix."""
    stated = (optional(F.get_json_object(raw, f"$.{k}.nationality")) for k in ("selector_values", "labeled_values"))
    return F.coalesce(*stated, name_and_nation(F.get_json_object(raw, "$.published_name_original"))[1])


def club_or_city(text: Column) -> Column:
    """club by a club's mark, city when all capitals without a digit, or else kept as an ambiguous club."""
    value = clean(text)
    letters = F.regexp_replace(value, r"\P{L}", "")
    city = (letters != "") & (F.upper(letters) == letters) & ~value.rlike(r"\d")
    return F.when(value.isNull(), F.lit(None).cast("string")).when(normalised(value).rlike(CLUB_MARKS), "club").when(city, "city").otherwise("ambiguous-kept-as-club")


def initials(bib: Column, name: Column) -> Column:
    """The bib's last three characters, or the initials of the name."""
    letters = F.array_join(F.transform(F.slice(F.split(F.trim(F.coalesce(name, F.lit(""))), r"\s+"), 1, 2), lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.coalesce(F.right(F.nullif(F.trim(bib), F.lit("")), F.lit(3)), letters)


def clock(s: Column) -> Column:
    """h:mm:ss."""
    t = F.floor(s + 0.5)
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    return F.concat(F.floor(t / 3600).cast("string"), F.lit(":"), two(F.floor(t % 3600 / 60)), F.lit(":"), two(t % 60))


def hour_minute(s: Column) -> Column:
    t = F.greatest(F.lit(0), F.floor(s))
    return F.concat(F.floor(t / 3600).cast("string"), F.lit(":"), F.lpad(F.floor(t % 3600 / 60).cast("string"), 2, "0"))


def pace_text(s: Column, suffix: str = " /km") -> Column:
    t = F.floor(s + 0.5)
    return F.when(s > 0, F.concat(F.floor(t / 60).cast("string"), F.lit(":"), F.lpad((t % 60).cast("string"), 2, "0"), F.lit(suffix)))


def speed_text(v: Column, suffix: str = " km/h") -> Column:
    tenths = F.floor(v * 10 + 0.5)
    return F.when(v > 0, F.concat(F.floor(tenths / 10).cast("string"), F.lit(","), (tenths % 10).cast("string"), F.lit(suffix)))


def control_name(text: Column) -> Column:
    """A control's name without the words for start and finish."""
    out = F.coalesce(text, F.lit(""))
    # fixed values: names of the ends of the course
    for name, short in (("Mora mål", "Mora"), ("Start Sälen", "Start")):
        out = F.replace(out, F.lit(name), F.lit(short))
    return F.trim(out)


def with_query(url: Column, changes: dict[str, str | None]) -> Column:
    """The URL with query parameters set, or removed for None; in the order of their names."""
    base, old = F.substring_index(url, "?", 1), F.str_to_map(F.when(url.contains("?"), F.substring_index(url, "?", -1)).otherwise(""), F.lit("&"), F.lit("="))
    kept = F.map_filter(old, lambda k, v: ~k.isin(*changes) & (k != ""))
    new = [x for k, v in changes.items() if v is not None for x in (F.lit(k), F.lit(v))]
    merged = F.map_concat(kept, F.create_map(*new)) if new else kept
    return F.concat(base, F.lit("?"), F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&"))
