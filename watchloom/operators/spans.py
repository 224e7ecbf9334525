"""Spans in text: titles, organisations with titles, locations, their overlaps and neighbours, and mention clean-up.

A span is a struct of name, category, start, stop, confidence. Offsets count from 0. Spans of a text are an array: overlap and
adjacency depend on order, so they are sweeps over the spans of one text, in time linear in them but for the sorting. Patterns are
matched inside Arrow batches, which gives offsets without counting through the text again for each match; an article is a row, and
its extractor's mentions reach it by a join.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

# Title patterns by category, matched whatever the case.
TITLES = {
    "EXECUTIVE": [
        r"\b(?:chief\s+)?(?:executive|operating|financial|technology|information|marketing|data|security)\s+officer\b",
        r"\b(?:ceo|coo|cfo|cto|cio|cmo|cdo|cso)\b",
        r"\bchief\s+(?:executive|operating|financial|technology|information|marketing|data|security)\b",
        r"\b(?:executive\s+)?(?:vice\s+)?president\b",
        r"\b(?:senior\s+)?(?:vice\s+)?president\s+of\s+\w+\b",
        r"\bdirector\s+(?:of\s+\w+|general)\b",
        r"\bmanaging\s+director\b",
        r"\bexecutive\s+director\b",
        r"\bsenior\s+director\b",
    ],
    "POLITICAL": [
        r"\bpresident\b(?!\s+of\s+(?:the\s+)?(?:company|corporation|board))",
        r"\bvice\s+president\b(?!\s+of\s+(?:the\s+)?(?:company|corporation|board))",
        r"\bprime\s+minister\b",
        r"\bchancellor\b",
        r"\bsecretary\s+of\s+\w+\b",
        r"\bminister\s+(?:of\s+\w+|for\s+\w+)?\b",
        r"\bsenator\b",
        r"\bcongressman|congresswoman\b",
        r"\brepresentative\b",
        r"\bgovernor\b",
        r"\bmayor\b",
        r"\bambassador\b",
    ],
    "PROFESSIONAL": [
        r"\b(?:senior\s+)?(?:software\s+)?(?:engineer|developer|architect|analyst|consultant)\b",
        r"\b(?:project\s+|program\s+)?manager\b",
        r"\b(?:team\s+)?lead(?:er)?\b",
        r"\bsupervisor\b",
        r"\bcoordinator\b",
        r"\bspecialist\b",
        r"\bexpert\b",
        r"\bprofessor\b",
        r"\bdoctor\b",
        r"\bdr\.\b",
        r"\blawyer\b",
        r"\battorney\b",
    ],
    "ACADEMIC": [
        r"\bprofessor\b",
        r"\bassociate\s+professor\b",
        r"\bassistant\s+professor\b",
        r"\bdean\b",
        r"\bprovost\b",
        r"\bchancellor\b(?=.*(?:university|college))",
        r"\bpresident\b(?=.*(?:university|college))",
        r"\bresearcher\b",
        r"\bscientist\b",
    ],
    "MILITARY": [
        r"\b(?:general|admiral|colonel|major|captain|lieutenant|sergeant|corporal|private)\b",
        r"\bcommander\b",
        r"\bofficer\b",
    ],
}
# An organisation and a title, in either order; only the title may be of any case. An organisation named last
# is followed by another word or by the end of the text, not by a mark.
ORGANISATION_TITLE = r"\b([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)?)\s+((?i:CEO|CTO|CFO|COO|President|Founder|Chairman))\b"
TITLE_OF_ORGANISATION = r"\b((?i:CEO|CTO|CFO|President|Founder))\s+of\s+([A-Z][a-zA-Z]+)(?=\s+[A-Za-z]{2}|\s*$)"
# Words that place something.
PLACES = [
    "headquarters", "office", "facility", "campus", "building",
    "center", "hub", "base", "station", "location", "site",
    "main office", "corporate facility", "regional center",
]
# What raises a compound's or a title's confidence.
KNOWN_ORGANISATIONS = ["tesla", "apple", "microsoft", "google", "amazon", "meta", "facebook", "twitter", "netflix", "uber", "airbnb"]
EXECUTIVE_TITLES = ["ceo", "cto", "cfo", "coo", "president", "founder", "chairman"]
BUSINESS_WORDS = ["company", "corporation", "inc", "ltd", "business", "startup", "firm"]
NEWS_WORDS = ["announced", "said", "stated", "according to", "reported"]
SPECIFIC_TITLES = ["president", "ceo", "cfo", "cto", "director", "manager"]
CATEGORY_WORDS = {
    "POLITICAL": ["government", "administration", "cabinet", "congress", "senate"],
    "EXECUTIVE": ["company", "corporation", "firm", "business", "organization"],
    "ACADEMIC": ["university", "college", "school", "research", "study"],
}
# What is no organisation in front of a title.
NOT_ORGANISATIONS = ["the", "a", "an", "this", "that", "these", "those", "his", "her", "their", "our", "my"]
CONNECTIVES = [
    "and", "or", "but", "with", "from", "to", "for", "by", "at", "in", "on",
    "while", "when", "as", "during", "before", "after", "since", "until",
    "because", "so", "therefore", "thus", "hence",
    "if", "unless", "provided", "assuming", "supposing",
    "than", "like", "unlike", "similar", "different",
]
GENERIC_WORDS = ["company", "corporation", "business", "organization", "firm", "group"]
# Mentions that are none.
PUNCTUATION = [".", ",", ";", ":", "!", "?", "(", ")", "[", "]", "{", "}", '"', "'", "-", "_"]
FALSE_POSITIVES = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]
# Words of nationality and rank, and title words, for neighbouring spans.
NATIONALITIES = [
    "american", "russian", "chinese", "british", "french", "german",
    "italian", "spanish", "japanese", "korean", "indian", "canadian",
    "australian", "brazilian", "mexican", "european", "asian", "african",
    "former", "current", "senior", "junior", "chief", "deputy", "acting",
]
DESCRIPTORS = ["former", "current", "senior", "junior", "chief", "deputy", "acting", "interim", "temporary", "permanent", "elected", "appointed", "retired"]
TITLE_WORDS = [
    "president", "minister", "secretary", "director", "manager", "officer",
    "leader", "chief", "head", "chairman", "ceo", "cfo", "cto", "coo",
    "governor", "mayor", "senator", "representative", "ambassador", "general",
    "admiral", "colonel", "captain", "judge", "justice", "professor", "doctor",
]


#: Runs of words put out at once.
RUNS = 1 << 16
#: A list of surfaces of at most so many bytes goes to every executor whole.
LISTED = 1 << 22
MATCH = "array<struct<name:string,start:int,stop:int>>"
SPAN = "array<struct<name:string,category:string,start:int,stop:int,confidence:double>>"
#: kind is what the span is (TITLE, COMPOUND_TITLE, ..., PERSON), category the group of patterns or the extractor's class.
EXTRACTED = "array<struct<span_id:int,name:string,kind:string,category:string,start:int,stop:int,confidence:double>>"
COMPOUND_KINDS = ["COMPOUND_TITLE", "NATIONAL_TITLE", "DESCRIPTIVE_TITLE", "ORGANIZATIONAL_TITLE"]


def _rows(kind: str, f: Callable[..., Iterable[tuple]]) -> Callable[..., Column]:
    """A column function that makes an array of structs of its arguments, row by row inside Arrow batches; null gives none."""

    target = to_arrow_type(StructType.fromDDL(f"x {kind}")["x"].dataType)

    @F.arrow_udf(kind)
    def run(*columns: pa.Array) -> pa.Array:
        at, flat = [0], []
        for args in zip(*(c.to_pylist() for c in columns), strict=True):
            if args[0] is not None:
                flat.extend(f(*args))
            at.append(len(flat))
        fields = list(target.value_type)
        values = zip(*flat, strict=True) if flat else [()] * len(fields)
        struct = pa.StructArray.from_arrays([pa.array(v, t.type) for v, t in zip(values, fields, strict=True)], fields=fields)
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), struct, type=target)

    return run


def matches(text: Column, pattern: str) -> Column:
    """Array of (name, start, stop) of a pattern's matches, in Python's syntax; offsets count characters from 0."""
    p = re.compile(pattern)
    return _rows(MATCH, lambda t: ((m.group(), m.start(), m.end()) for m in p.finditer(t)))(text)


class Follows:
    """A pattern that asks for a word later in its line. Looking ahead from each match would read the line again and again, so the
    places of the word are found once, and a binary search tells whether one stands between the match and the line's end."""

    def __init__(self, pattern: str):
        base, _, ahead = pattern.partition("(?=.*")
        self.base, self.ahead = re.compile(base, re.IGNORECASE), re.compile(ahead.removesuffix(")"), re.IGNORECASE) if ahead else None

    def finditer(self, text: str) -> Iterable[re.Match]:
        found = self.base.finditer(text)
        if self.ahead is None:
            return found
        found = list(found)
        places = [m.start() for m in self.ahead.finditer(text)] if found else []

        def on(m: re.Match) -> bool:
            at = bisect_left(places, m.end())
            return at < len(places) and "\n" not in text[m.end() : places[at]]

        return (m for m in found if on(m))


_TITLES = [(category, Follows(p)) for category, patterns in TITLES.items() for p in patterns]
_COMPOUNDS = [(re.compile(ORGANISATION_TITLE), 1, 2), (re.compile(TITLE_OF_ORGANISATION), 2, 1)]
# a word is read once: a run of word characters starts where none stands before it, and gives nothing back
_WORD = r"(?<!\w)(\w++)"
_PLACES = "|".join(PLACES)
_LOCATIONS = [
    (re.compile(rf"{_WORD}'s\s+(\w++)\s+({_PLACES})", re.IGNORECASE), "COMPOUND_LOCATION", 0.85),
    (re.compile(rf"{_WORD}\s+(\w++)\s+({_PLACES})", re.IGNORECASE), "COMPOUND_LOCATION", 0.80),
    (re.compile(rf"\b({_PLACES})\b", re.IGNORECASE), "LOCATION_DESCRIPTOR", 0.75),
]


def _near(text: str, start: int, stop: int, around: int = 50) -> str:
    return text[max(0, start - around) : stop + around].lower()


def _has(text: str, words: list[str]) -> bool:
    return any(w in text for w in words)


def _title_confidence(name: str, near: str, category: str) -> float:
    c = 0.7 + (0.1 if _has(name.lower(), SPECIFIC_TITLES) else 0.0)
    return min(1.0, c + (0.15 if _has(near, CATEGORY_WORDS.get(category, [])) else 0.0))


def _compound_confidence(organisation: str, title: str, near: str) -> float:
    c = 0.75 + (0.08 if organisation.lower() in KNOWN_ORGANISATIONS else 0.0) + (0.05 if title.lower() in EXECUTIVE_TITLES else 0.0)
    return min(0.90, c + (0.03 if _has(near, BUSINESS_WORDS) else 0.0) + (0.02 if _has(near, NEWS_WORDS) else 0.0))


def _title_spans(text: str) -> list[tuple]:
    return [(m.group(), category, m.start(), m.end(), _title_confidence(m.group(), _near(text, m.start(), m.end()), category)) for category, p in _TITLES for m in p.finditer(text)]


def _is_organisation(name: str) -> bool:
    n = name.lower()
    return n not in NOT_ORGANISATIONS + GENERIC_WORDS and not any(w in CONNECTIVES for w in n.split())


def _names_person(name: str, people: dict[str, list[list[str]]]) -> bool:
    """Whether the words of a person stand in the name, or the name's words in a person's, one after the other."""
    w = name.lower().split()
    inside = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    return any(inside(w, p) or inside(p, w) for x in dict.fromkeys(w) for p in people.get(x, ()))


def _people(names: Iterable[str]) -> dict[str, list[list[str]]]:
    """People by each of their words: names that share no word with an organisation are never looked at."""
    out: dict[str, list[list[str]]] = {}
    for n in dict.fromkeys(x.lower() for x in names):
        for w in dict.fromkeys(n.split()):
            out.setdefault(w, []).append(n.split())
    return out


def _compound_spans(text: str, people: dict[str, list[list[str]]] | None = None) -> list[tuple]:
    out = []
    for p, org, title in _COMPOUNDS:
        for m in p.finditer(text):
            o, t = re.sub(r"^(?i:the|a|an)\s+(?=\S)", "", m.group(org)), m.group(title)
            if _is_organisation(o) and not (people and _names_person(o, people)):
                out.append((f"{o} {t}", "COMPOUND_EXECUTIVE", m.start(), m.end(), _compound_confidence(o, t, _near(text, m.start(), m.end())), o, t))
    return out


def _location_spans(text: str) -> list[tuple]:
    return [(m.group(), category, m.start(), m.end(), conf) for p, category, conf in _LOCATIONS for m in p.finditer(text)]


def titles(text: Column) -> Column:
    """All title matches of all categories, unresolved."""
    return _rows(SPAN, _title_spans)(text)


def compounds(text: Column, people: Column | None = None) -> Column:
    """Organisation-with-title spans (name is "Organisation Title" for either order), valid ones only: an organisation that is part of a
    person's name, or holds one, is none. people: an array of names."""
    kind = SPAN.replace("confidence:double", "confidence:double,organisation:string,title:string")
    return _rows(kind, _compound_spans)(text) if people is None else _rows(kind, lambda t, n: _compound_spans(t, _people(n or [])))(text, people)


def locations(text: Column) -> Column:
    return _rows(SPAN, _location_spans)(text)


def compound_confidence(organisation: Column, title: Column, context: Column) -> Column:
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(F.lower(context), F.lit(w)) for w in words])
    c = F.lit(0.75) + F.when(F.lower(organisation).isin(KNOWN_ORGANISATIONS), 0.08).otherwise(0.0)
    c = c + F.when(F.lower(title).isin(EXECUTIVE_TITLES), 0.05).otherwise(0.0)
    return F.least(c + F.when(has(BUSINESS_WORDS), 0.03).otherwise(0.0) + F.when(has(NEWS_WORDS), 0.02).otherwise(0.0), F.lit(0.90))


def overlaps(a: Column, b: Column) -> Column:
    return (a.start < b.stop) & (b.start < a.stop)


def _greedy(spans: list[dict], ranks: list[float]) -> Iterable[tuple]:
    """Kept spans never overlap, so a span meets at most the one that starts last before its end: a binary search finds it."""
    starts, kept = [], []
    for _, _, _, _, s in sorted((r, s["start"], -s["stop"], s["name"], i) for i, (s, r) in enumerate(zip(spans, ranks, strict=True))):
        s = spans[s]
        at = bisect_left(starts, s["stop"])
        if not at or kept[at - 1]["stop"] <= s["start"]:
            starts.insert(at, s["start"])
            kept.insert(at, s)
    return (tuple(s.values()) for s in kept)


def resolve(spans: Column, priority) -> Column:
    """Greedy: in order of priority (least first), then start, then longest, a span stays unless it overlaps one that stays; by start."""
    ranks = F.transform(spans, lambda s: priority(s).cast("double"))
    return _rows(SPAN, _greedy)(spans.cast(SPAN), ranks)


def _boost(first: str, kind: str, second: str, second_kind: str) -> tuple[str, float] | None:
    """The compound that two neighbours make, and what it adds to their confidence: (kind, boost), or None."""
    first, second = first.strip().lower(), second.strip().lower()
    if kind not in ("MISCELLANEOUS", "ORGANIZATION") or second_kind != "TITLE" or second not in TITLE_WORDS:
        return None
    if first in NATIONALITIES:
        return "NATIONAL_TITLE", 0.15
    if first in DESCRIPTORS:
        return "DESCRIPTIVE_TITLE", 0.10
    return ("ORGANIZATIONAL_TITLE", 0.12) if kind == "ORGANIZATION" else ("COMPOUND_TITLE", 0.05)


def _neighbours(spans: list[tuple], gap: int) -> tuple[list[tuple], set[int]]:
    """(name, kind, start, stop, confidence) of the compounds of consecutive spans (the same fields), and which spans they use."""
    order = sorted(range(len(spans)), key=lambda i: spans[i][2])
    out, used = [], set()
    for i, j in zip(order, order[1:], strict=False):
        (n1, k1, a, end, c1), (n2, k2, start, b, c2) = spans[i], spans[j]
        if i in used or not 0 <= start - end <= gap:
            continue
        made = _boost(n1, k1, n2, k2)
        if made:
            out.append((f"{n1} {n2}", made[0], a, b, min(0.90, (c1 + c2) / 2 + made[1])))
            used |= {i, j}
    return out, used


def adjacent(spans: Column, gap: int = 10) -> Column:
    """Compounds of consecutive spans at most ``gap`` characters apart, each span used once, from the left; category is the kind."""
    return _rows(SPAN, lambda s: _neighbours([tuple(x.values()) for x in s], gap)[0])(spans.cast(SPAN))


def _admit(kept: list[tuple], new: Iterable[tuple]) -> list[tuple]:
    """One sweep over two lists by start: of the new spans those that overlap neither a kept one nor a new one let in before."""
    out, at, reach = [], 0, 0
    for s in sorted(new, key=lambda x: x[3]):
        while at < len(kept) and kept[at][4] <= s[3]:
            out.append(kept[at])
            at += 1
        if s[3] >= reach and not (at < len(kept) and kept[at][3] < s[4]):
            out.append(s)
            reach = s[4]
    return out + kept[at:]


def combine(text: str, mentions: list[dict], gap: int = 10) -> list[tuple]:
    """The spans of one article: titles, compounds, locations and the extractor's mentions, without overlaps.

    Every span has a number: mentions first, in the extractor's order by place, then titles, then locations. Neighbours are looked for among all of them;
    what becomes part of a compound is used up. Then spans are let in by class: compounds of neighbours, compounds of the
    patterns, titles, locations, mentions, each class in one sweep by start.
    """
    ner = sorted(((m["name"], m["category"], m["start"], m["stop"], m["confidence"]) for m in mentions), key=lambda m: (m[2], -m[3], m[1], m[0]))
    people = _people(m[0] for m in ner if m[1] == "PERSON")
    found = [(n, "COMPOUND_TITLE", c, a, b, x) for n, c, a, b, x, *_ in _compound_spans(text, people)]
    found = _admit(_admit([], found), [(n, "TITLE", c, a, b, x) for n, c, a, b, x in _title_spans(text)])
    places = _admit([], [(n, c, c, a, b, x) for n, c, a, b, x in _location_spans(text)])
    every = [(n, c, c, a, b, x) for n, c, a, b, x in ner] + found + places
    made, used = _neighbours([(n, k, a, b, x) for n, k, _, a, b, x in every], gap)
    pattern, title = range(len(ner), len(ner) + len(found)), range(len(ner) + len(found), len(every))
    spans = [(*every[i], i) for i in range(len(every))]
    kept = _admit([], [(n, k, k, a, b, x, len(every) + i) for i, (n, k, a, b, x) in enumerate(made)])
    kept = _admit(kept, [spans[i] for i in pattern if spans[i][1] == "COMPOUND_TITLE"])
    kept = _admit(kept, [spans[i] for i in pattern if spans[i][1] == "TITLE" and i not in used])
    kept = _admit(kept, [spans[i] for i in title])
    kept = _admit(kept, [spans[i] for i in range(len(ner)) if i not in used])
    return [(i, n, k, c, a, b, x) for n, k, c, a, b, x, i in kept]


def spread(rows: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """A table read as fewer parts than there are cores, dealt over them: matching costs far more than moving a small table.

    ``read``: what ``rows`` were made from; counting the parts of a plan with joins would run them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if (rows if read is None else read).rdd.getNumPartitions() < cores else rows


def extract(articles: DataFrame, text: str = "text", extractor: Callable[[DataFrame], DataFrame] | None = None, key: str = "article_id") -> DataFrame:
    """Articles with ``spans``, by start: what ``combine`` keeps, without mentions that are none (``is_mention``).

    ``extractor`` is a function from articles (``key``, text) to rows of ``key``, name, category, start, stop, confidence (see
    ``enrich.with_mentions``); the mentions of an article meet its text by a join on ``key``. Without one only the patterns are used.
    An article whose key is null has no mentions. A null or empty text has no spans.
    """
    rows = articles
    none = F.array().cast(SPAN)
    if extractor is None:
        rows = rows.withColumn("_wl_ner", none)
    else:
        found = extractor(articles.select(key, F.col(text).alias("text"))).where("start < stop")
        per = found.groupBy(key).agg(F.collect_list(F.struct("name", "category", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), F.col("confidence").cast("double").alias("confidence"))).alias("_wl_ner"))
        rows = rows.join(per, key, "left").withColumn("_wl_ner", F.coalesce("_wl_ner", none))
    rows = spread(rows, articles)
    spans = _rows(EXTRACTED, combine)(F.col(text), F.col("_wl_ner"))
    return rows.withColumn("spans", F.filter(spans, lambda s: is_mention(s["name"], s.kind))).drop("_wl_ner")


def is_mention(name: Column, kind: Column) -> Column:
    """No single character, punctuation, or common word taken for a person or organisation."""
    n = F.trim(name)
    return (F.length(n) > 1) & ~n.isin(PUNCTUATION) & ~(F.lower(n).isin(FALSE_POSITIVES) & kind.isin("PERSON", "ORGANIZATION"))


def gazetteer(articles: DataFrame, surfaces: DataFrame) -> DataFrame:
    """The default extractor: words and runs of words of a text that are a surface of the watch list, with offsets.

    Joined on the lower-cased text of one, two, or as many consecutive words as some surface has, so the list may be of any
    size. The word counts of the list and its bytes are read at once. Runs leave the text cut out, so no row carries the text along, and in
    batches of about ``RUNS``, however long the texts are.

    Spark guesses the size of the runs from the articles' file, which can be hundreds of times smaller, and might collect them in the driver to
    broadcast them. So the join is settled here: a list of up to ``LISTED`` bytes goes to the runs, else both sides are shuffled and sorted.
    """
    word = r"[\p{L}\p{N}]+"
    n = F.size(F.regexp_extract_all("surface", F.lit(word), F.lit(0)))
    size = F.octet_length("surface") + F.coalesce(F.octet_length(F.col("entity_id").cast("string")), F.lit(0)) + 64
    told = surfaces.agg(F.collect_set(F.when(n > 2, n)).alias("counts"), F.sum(size).alias("bytes")).first()
    sizes = sorted({1, 2, *told.counts})

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            made = lambda rows, ids=ids: pa.RecordBatch.from_arrays([ids.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int32())], names=["article_id", "name", "position"])
            rows: tuple[list, list, list] = ([], [], [])
            for i in range(len(texts)):
                text = texts[i].as_py()
                at = [m.span() for m in re.finditer(r"[^\W_]+", text)] if text else []
                for n in sizes:
                    for first in range(0, len(at) - n + 1, RUNS):
                        part = range(first, min(first + RUNS, len(at) - n + 1))
                        rows[0].extend([i] * len(part))
                        rows[1].extend([text[at[j][0] : at[j + n - 1][1]] for j in part])
                        rows[2].extend([at[j][0] for j in part])
                        if len(rows[0]) >= RUNS:
                            yield made(rows)
                            rows = ([], [], [])
            yield made(rows)

    a = articles.select("article_id", F.col("text").cast("string").alias("text"))
    named = spread(a).mapInArrow(runs, f"article_id {a.schema['article_id'].dataType.simpleString()}, name string, position int")
    s = surfaces.select(F.lower("surface").alias("_s"), "entity_id")
    s = s.hint("broadcast" if (told.bytes or 0) <= LISTED else "merge")
    return named.join(s, F.lower("name") == F.col("_s")).select("article_id", "name", "position", "entity_id")
