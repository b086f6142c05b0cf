"""Participant pages: the whole record and its passages, whatever layout the page has.

A page becomes a list of elements.  Each place where a page may state a time yields sightings, and a control's
sightings are merged by their rank: rows of class split state all fields; a cell that names a control by its class
corrects the time alone; a table with a header fills in what nothing has stated.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempotrail.functions.text import plain

# fixed values: classes of the elements that state a field, the better first
CLASSES = {
    "name": ("f-__fullname",),
    "bib": ("f-start_no_text", "f-start_no"),
    "net_time": ("f-time_finish_netto",),
    "gun_time": ("f-time_finish_brutto",),
    "finish_time": ("f-time_finish",),
    "overall_place": ("f-place_nosex",),
    "gender_place": ("f-place_all",),
    "class_place": ("f-place_age",),
    "sex": ("f-sex", "f-gender"),
    "age_class": ("f-age_class", "f-ak"),
    "nationality": ("f-nation", "f-nationality"),
    "club": ("f-club", "f-association"),
    "city": ("f-city", "f-place_of_residence"),
    "start_group": ("f-start_group",),
    "status": ("f-status",),
}
# fixed values: labels of a field, as they read without marks
LABELS = {
    "bib": ("startnr", "startnummer", "bib", "start no"),
    "name": ("namn", "name"),
    "sex": ("kon", "gender", "sex"),
    "age_class": ("klass", "aldersklass", "age group"),
    "nationality": ("nation", "nationalitet", "country"),
    "club": ("klubb", "forening", "club", "team"),
    "city": ("ort", "stad", "city"),
    "county": ("lan", "county"),
    "status": ("status",),
    "finish_time": ("sluttid", "tid", "resultat", "finish"),
    "net_time": ("netto", "net time", "chip time"),
    "gun_time": ("brutto", "gun time"),
    "overall_place": ("totalplacering", "placering totalt", "overall", "place overall"),
    "gender_place": ("konsplacering", "gender place"),
    "class_place": ("klassplacering", "age group place"),
}
CLUB_OR_CITY = "klubb stad"
# fixed values: classes of a passage's cells, and words of a table's header, by field
CELLS = {
    "elapsed": ("time", "elapsed", "time_total"),
    "time_of_day": ("time_day", "daytime", "time_of_day", "timeofday"),
    "segment": ("diff",),
    "behind": ("difference",),
    "pace": ("min_km", "minkm", "pace"),
    "speed": ("kmh", "speed"),
    "place": ("place", "rank", "placement"),
}
CONTROL_CELLS = ("desc", "name", "split-name")
FINISH_ROWS = ("f-time_finish_brutto", "f-time_finish_netto", "f-time_finish", "finish")
HEADERS = {
    "time_of_day": ("time of day", "klockslag", "klockan"),
    "place": ("plac", "place", "rank"),
    "segment": ("stracktid", "segment", "leg time"),
    "behind": ("diff", "efter"),
    "pace": ("min km", "pace"),
    "speed": ("km h", "speed"),
}
CONTROL_HEADERS = ("kontroll", "checkpoint", "split", "station", "plats")
ELAPSED_HEADERS = ("mellantid", "elapsed", "loptid", "race time", "time")
# fixed values: status words, and those looked for in a page without a status
STATUS_WORDS = {
    "DNF": ("dnf", "brutit", "brot", "avbrutit"),
    "DNS": ("dns", "ej start", "ej startat", "inte startat", "startade inte"),
    "UNKNOWN": ("startat", "started"),
    "DSQ": ("dsq", "diskvalificerad"),
    "FINISHED": ("finished", "finisher", "i mal", "malgang"),
}
STATUS_PHRASES = {"DNF": "did not finish", "DNS": "did not start", "DSQ": "disqualified"}
# fixed values: other words of the sexes, labels of a real finish, spellings of nothing
SEX_WORDS = {"M": ("m", "h", "man", "male", "men", "herr", "herrar"), "F": ("d", "f", "w", "k", "woman", "women", "female", "dam", "damer", "kvinna")}
FINISH_LABELS = ("mal", "mora mal", "finish")
NOTHING = ("n a", "na", "saknas", "ej angivet", "unknown")
# fixed values: controls by the words that name them, in the order in which they are tried
CONTROLS = (
    ("hogsta punkten", "high_point"), ("mora forvarning", "mora_warning"), ("lillsjon", "lillsjon"), ("start", "start"), ("salen", "start"), ("smagan", "smagan"), ("mangsbodarna", "mangsbodarna"),
    ("risberg", "risberg"), ("evertsberg", "evertsberg"), ("oxberg", "oxberg"), ("hokberg", "hokberg"), ("eldris", "eldris"), ("mora", "mora"), ("mal", "mora"), ("finish", "mora"),
)
START, FINISH = "start", "mora"
#: Seconds by which a finish row may differ from the stated finish before it counts instead.
FINISH_SLACK = 60
LONGEST_NAME = 160

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag closes an open one of its group, up to the element that holds the group.
_GROUPS = {"tr": ({"tr"}, "table"), "td": ({"td", "th"}, "tr"), "th": ({"td", "th"}, "tr"), "dt": ({"dt", "dd"}, "dl"), "dd": ({"dt", "dd"}, "dl"), "li": ({"li"}, "ul"), "option": ({"option"}, "select")}
_CLOCK = re.compile(r"(?<!\d)(?:(\d{1,2}):)?([0-5]?\d):([0-5]\d)(?!\d)")


@dataclass(eq=False)
class Element:
    tag: str
    classes: frozenset[str] = frozenset()
    parent: Element | None = None
    href: str | None = None
    inner: list = field(default_factory=list)
    #: All elements inside, in order; of a whole page only, where it is asked for often.
    every: list[Element] | None = None

    def walk(self) -> Iterator[Element]:
        if self.every is not None:
            yield from self.every
            return
        todo = [x for x in reversed(self.inner) if isinstance(x, Element)]
        while todo:
            yield (x := todo.pop())
            todo.extend(y for y in reversed(x.inner) if isinstance(y, Element))

    def text(self) -> str | None:
        parts: list[str] = []
        todo = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, Element):
                todo.extend(reversed(x.inner))
            else:
                parts.append(x)
        return " ".join(" ".join(parts).split()) or None

    def cells(self) -> list[Element]:
        return [x for x in self.inner if isinstance(x, Element) and x.tag in ("td", "th")]

    def of_class(self, *names: str) -> str | None:
        """The first text in the elements of the first class that has one."""
        for name in names:
            first = next((x for x in self.walk() if name in x.classes), None)
            if first and (text := first.text()):
                return text
        return None


#: A comment, a script or style, a declaration, a tag (its end mark, name and attributes), or text.
_TOKEN = re.compile(r"""(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|<[!?][^>]*>|<(/?)([a-z][\w:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|([^<]+|<)""")
_ATTRIBUTE = re.compile(r"""(?i)(?<![\w-])(class|href)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")


def elements(html: str | None) -> Element:
    """A page's elements under a root; whatever is not closed or not opened properly is put where a browser would, or left out."""
    root = at = Element("", every=[])
    for m in _TOKEN.finditer(html or ""):
        end, tag, attributes, text = m.groups()
        if text is not None:
            at.inner.append(unescape(text) if "&" in text else text)
        elif tag and end:
            tag, open_one = tag.lower(), at
            while open_one.parent and open_one.tag != tag:
                open_one = open_one.parent
            at = open_one.parent or at
        elif tag:
            tag = tag.lower()
            same, holder = _GROUPS.get(tag, ((), ""))
            open_one = at
            while same and open_one.parent and open_one.tag != holder:
                if open_one.tag in same:
                    at = open_one.parent
                    break
                open_one = open_one.parent
            of = {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
            e = Element(tag, frozenset(of.get("class", "").split()), at, of.get("href"))
            at.inner.append(e)
            root.every.append(e)
            if tag not in _VOID and not attributes.endswith("/"):
                at = e
    return root


_NOT_KEY = re.compile("[^a-z0-9]+")


def key(text: str | None) -> str:
    text = text or ""
    return _NOT_KEY.sub(" ", (text if text.isascii() else plain(text)).lower()).strip()


def control(text: str | None) -> str | None:
    """The key of the first control whose words stand in the text."""
    words = f" {key(text)} "
    return next((k for alias, k in CONTROLS if f" {alias} " in words), None)


def clock(text: str | None) -> int | None:
    m = _CLOCK.search(text or "")
    return int(m[1] or 0) * 3600 + int(m[2]) * 60 + int(m[3]) if m else None


def _signed(text: str | None) -> int | None:
    s = clock(text)
    return -s if s is not None and text.startswith("-") else s


def _pace(text: str | None) -> int | None:
    m = re.search(r"(\d{1,2})[:.,](\d{2})", text or "")
    return int(m[1]) * 60 + int(m[2]) if m else None


def _number(text: str | None) -> float | None:
    m = re.search(r"-?\d+(?:[.,]\d+)?", (text or "").replace(" ", ""))
    return float(m[0].replace(",", ".")) if m else None


def _whole(text: str | None) -> int | None:
    m = re.search(r"\d+", "".join((text or "").split()))
    return int(m[0]) if m else None


#: How a passage's texts become values.
PARSERS = {"time_of_day": lambda x: x, "segment": clock, "behind": _signed, "pace": _pace, "speed": _number, "place": _whole}


def _estimated(row: Element) -> bool:
    """Forecasts are marked by a class or by a star in bold print."""
    return "estimated" in row.classes or ("*" in (row.text() or "") and any(x.tag == "strong" for x in row.walk()))


def _of_rows(page: Element) -> Iterator[tuple[str, dict]]:
    rows = [x for x in page.walk() if x.tag == "tr"]
    ends = [r for r in rows if r.classes & set(FINISH_ROWS)]
    for row in [*(r for r in rows if "split" in r.classes), *ends]:
        label = row.of_class(*CONTROL_CELLS) or ("Mora mål" if row in ends else None)
        at = control(label)
        elapsed = clock(row.of_class(*CELLS["elapsed"]) or row.of_class(*FINISH_ROWS))
        if at and not _estimated(row) and (elapsed is not None or at == START):
            yield at, {"label": label, "elapsed": elapsed or 0, **{f: parse(row.of_class(*CELLS[f])) for f, parse in PARSERS.items()}}


def _of_cells(page: Element) -> Iterator[tuple[str, int]]:
    for x in page.walk():
        named = next((c for c in sorted(x.classes) if c.startswith("f-time_") and "finish" not in c), None) if x.classes and x.tag in ("td", "span") else None
        if named and (at := control(named.removeprefix("f-time_"))) and (elapsed := clock(x.text())) is not None:
            yield at, elapsed


def _of_tables(page: Element) -> Iterator[tuple[str, dict]]:
    for table in (x for x in page.walk() if x.tag == "table"):
        rows = [[c.text() or "" for c in r.cells()] for r in table.walk() if r.tag == "tr" and not _estimated(r)]
        rows = [r for r in rows if r]
        if len(rows) < 2:
            continue
        header = [key(c) for c in rows[0]]
        columns = lambda words: [i for i, h in enumerate(header) if any(w in h for w in words)]
        name = (columns(CONTROL_HEADERS) or [0])[0]
        times = columns(ELAPSED_HEADERS)
        others = {f: i[0] for f, words in HEADERS.items() if (i := columns(words))}
        for cells in rows[1:]:
            at = control(cells[name]) if name < len(cells) else None
            elapsed = clock(cells[times[-1]]) if times and times[-1] < len(cells) else None
            if elapsed is None:
                elapsed = next((t for c in cells[1:] if (t := clock(c)) is not None), None)
            if at and (elapsed is not None or at == START):
                yield at, {"label": cells[name], "elapsed": elapsed or 0, **{f: PARSERS[f](cells[i] or None) for f, i in others.items() if i < len(cells)}}


def passages(page: Element, controls: Sequence[str]) -> list[dict]:
    """The passages at the controls, in their order."""
    found: dict[str, dict] = {}
    for at, stated in _of_rows(page):
        found[at] = found.get(at, {}) | stated
    for at, elapsed in _of_cells(page):
        found.setdefault(at, {})["elapsed"] = elapsed
    for at, stated in _of_tables(page):
        found[at] = stated | found.get(at, {})
    return [{"checkpoint_key": k, **found[k]} for k in controls if k in found]


def labelled(page: Element) -> dict[str, str]:
    """Label (as a key) to value, of rows of two cells and of dt and dd; the last that isn't empty counts."""
    pairs = [[c.text() for c in x.cells()] for x in page.walk() if x.tag == "tr"]
    for dl in {id(x.parent): x.parent for x in page.walk() if x.tag == "dt"}.values():
        inner = [x for x in dl.inner if isinstance(x, Element) and x.tag in ("dt", "dd")]
        pairs += [[a.text(), b.text()] for a, b in zip(inner, inner[1:], strict=False) if (a.tag, b.tag) == ("dt", "dd")]
    return {key(p[0]): p[1] for p in pairs if len(p) == 2 and p[1]}


def list_entries(html: str | None) -> list[dict]:
    """The participants that a list page links to: idp, url, the link's text as the name, and what the link's surroundings state."""
    out = []
    for link in (x for x in elements(html).walk() if x.tag == "a"):
        found = re.search(r"[?&]idp=([^&#]+)", link.href or "")
        if not found:
            continue
        around = link.parent
        while around and around.tag not in ("li", "tr", "article", "div"):
            around = around.parent
        fields = {f: around.of_class(*names) for f, names in CLASSES.items()} if around else {}
        out.append({"idp": found[1], "url": link.href, **fields, "name": link.text() or fields.get("name"), "list_text": around.text() if around else None})
    return out


ENTRY = ("url", *CLASSES, "list_text")


def entries(lists: DataFrame, order_col: str = "page", html_col: str = "html") -> DataFrame:
    """One row an idp of list pages (an order, html): of each field the first value in the order of pages and links."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"page": p, "pos": i, **e} for p, h in zip(batch["page"], batch["html"], strict=True) for i, e in enumerate(list_entries(h))]
            yield pd.DataFrame(rows, columns=["page", "pos", "idp", *ENTRY])

    schema = "page long, pos long, idp string, " + ", ".join(f"{f} string" for f in ENTRY)
    found = lists.select(F.col(order_col).cast("long").alias("page"), F.col(html_col).alias("html")).mapInPandas(parse, schema)
    first = lambda f: F.min(F.when(F.col(f).isNotNull(), F.struct("page", "pos", f)))[f].alias(f)
    return found.groupBy("idp").agg(*map(first, ENTRY))


def cached(spark: SparkSession, path: str) -> DataFrame:
    """Pages that were fetched before: page_id (the file's name without its ending) and html."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[A-Za-z]+)*$", 1)
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.url_decode(name).alias("page_id"), F.col("value").alias("html"))


def status_word(text: str | None) -> str | None:
    k = key(text)
    for code, words in STATUS_WORDS.items():
        if k in words or (code in STATUS_PHRASES and STATUS_PHRASES[code] in k):
            return code
    return text.upper() if k else None


def _optional(text: str | None) -> str | None:
    return text if text and any(c.isalnum() for c in text) and key(text) not in NOTHING else None


def _sex(stated: str | None, age_class: str | None) -> str | None:
    word = key(_optional(stated))
    by_word = next((code for code, words in SEX_WORDS.items() if word in words), None)
    first = (age_class or "").strip().upper()[:1]
    return by_word or ("M" if first in ("M", "H") and first else "F" if first in ("W", "D", "K") and first else None)


def _club_and_city(text: str) -> tuple[str | None, str | None]:
    """A text that is a club or a city: by a club's word, else a city in capitals without a digit."""
    is_club = re.search(r"(^|\s)(if|fk|sk|ok|ik|aik|team|club|klubb|forening)(\s|$)|loparklubb|friidrott|runacademy|running", key(text))
    is_city = not is_club and any(c.isalpha() for c in text) and text.upper() == text and not any(c.isdigit() for c in text)
    return (None, text) if is_city else (text, None)


def participant(html: str | None, controls: Sequence[str]) -> dict:
    """The record that a page states."""
    page = elements(html)
    forecasts = [x for x in page.every if x.tag == "tr" and "estimated" in x.classes]
    gone = {id(y) for x in forecasts for y in x.walk()}
    for x in forecasts:
        x.inner = []
    page.every = [x for x in page.every if id(x) not in gone]
    by_class: dict[str, list[Element]] = {}
    for x in page.every:
        for c in x.classes:
            by_class.setdefault(c, []).append(x)
    labels = labelled(page)

    def of_class(name: str) -> str | None:
        every = by_class.get(name, [])
        # of a row the second cell, for the first is a label
        texts = ((c[1].text() if len(c := x.cells()) > 1 else None) if x.tag == "tr" else x.text() for x in sorted(every, key=lambda x: x.tag != "td"))
        return next((t for t in texts if t), None)

    value = {f: next((t for c in names if (t := of_class(c))), None) or next((labels[a] for a in LABELS.get(f, ()) if a in labels), None) for f, names in CLASSES.items()}
    title = next((t for x in page.walk() if (x.tag in ("h1", "h2") or x.classes & {"athlete-name", "participant-name"}) and (t := x.text())), None)
    name = value["name"] or (title if title and len(title) < LONGEST_NAME else None)
    suffix = re.search(r"\s*\(([A-Za-z]{3})\)$", name or "")
    status = status_word(value["status"])
    if not status:
        body = f" {key(page.text())} "
        status = next((code for code in ("DNF", "DNS", "DSQ") if f" {STATUS_PHRASES[code]} " in body or f" {code.lower()} " in body), None)
    net, gun = clock(value["net_time"]), clock(value["gun_time"])
    finish = clock(value["finish_time"])
    finish = finish if finish is not None else net if net is not None else gun
    status = status or ("UNKNOWN" if finish is None else "FINISHED")
    splits = passages(page, controls)
    end = next((s for s in splits if s["checkpoint_key"] == FINISH), None)
    if end and (finish is None or (key(end.get("label")) in FINISH_LABELS and abs(finish - end["elapsed"]) > FINISH_SLACK)):
        finish, status = end["elapsed"], "FINISHED"
        gun = finish if gun is None or abs(gun - finish) > FINISH_SLACK else gun
    if finish is not None and not end and FINISH in controls:
        splits.append({"checkpoint_key": FINISH, "elapsed": finish, "synthetic": True})
    club, city = value["club"], value["city"]
    if CLUB_OR_CITY in labels:
        club, own_city = _club_and_city(labels[CLUB_OR_CITY])
        city = own_city or city
    return {
        "name": name[: suffix.start()].strip() if suffix else name, "bib": value["bib"], "sex": _sex(value["sex"], value["age_class"]), "age_class": _optional(value["age_class"]),
        "nationality": _optional(value["nationality"]) or (suffix[1].upper() if suffix else None), "club": club, "city": city, "county": labels.get("lan") or labels.get("county"), "start_group": value["start_group"],
        "status": status, "finish_seconds": finish, "gun_seconds": gun, "net_seconds": net, "overall_place": _whole(value["overall_place"]), "gender_place": _whole(value["gender_place"]), "class_place": _whole(value["class_place"]),
        "splits": splits, "raw": json.dumps({"selector_values": value, "labeled_values": {f: labels[a] for f, names in LABELS.items() for a in names if a in labels}, "published_name_original": name}, ensure_ascii=False),
    }


SPLIT = "struct<checkpoint_key:string,source_label:string,elapsed_seconds:long,time_of_day:string,segment_seconds:long,diff_seconds:long,reported_pace_seconds_per_km:long,speed_kmh:double,place_gender:long,is_synthetic:boolean>"
_SPLIT_FIELDS = {"checkpoint_key": "checkpoint_key", "source_label": "label", "elapsed_seconds": "elapsed", "time_of_day": "time_of_day", "segment_seconds": "segment", "diff_seconds": "behind", "reported_pace_seconds_per_km": "pace", "speed_kmh": "speed", "place_gender": "place"}
TEXTS = ("name", "bib", "sex", "age_class", "nationality", "club", "city", "county", "start_group", "status")
NUMBERS = ("finish_seconds", "gun_seconds", "net_seconds", "overall_place", "gender_place", "class_place")


def participants(pages: DataFrame, controls: Sequence[str], id_col: str = "id", html_col: str = "html") -> DataFrame:
    """pages (an id as text, html) as records: id, the fields of a result, splits, and raw (what the page stated, as JSON).

    A null page has a record without fields, of status UNKNOWN.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [participant(h, controls) for h in batch["html"]]
            for r in rows:
                r["splits"] = [{to: s.get(of) for to, of in _SPLIT_FIELDS.items()} | {"is_synthetic": s.get("synthetic", False)} for s in r["splits"]]
            out = pd.DataFrame(rows, columns=[*TEXTS, *NUMBERS, "splits", "raw"]).astype({c: "Int64" for c in NUMBERS})
            out.insert(0, "id", batch["id"].to_numpy())
            yield out

    schema = ", ".join(["id string", *(f"{c} string" for c in TEXTS), *(f"{c} long" for c in NUMBERS), f"splits array<{SPLIT}>", "raw string"])
    return pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).alias("html")).mapInPandas(parse, schema)


def control_key(text: Column, aliases: Sequence[tuple[str, str]] = CONTROLS) -> Column:
    """The key of the first alias that is the text or a run of its words."""
    from tempotrail.functions.text import normalised

    words = F.concat(F.lit(" "), normalised(text), F.lit(" "))
    return F.coalesce(*(F.when(words.contains(f" {alias} "), F.lit(k)) for alias, k in aliases))
