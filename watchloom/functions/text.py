"""Scalar text and vector functions as Column expressions; all stay in generated JVM code or higher-order functions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Honorifics and suffixes that name variations drop.
PREFIXES = ["mr.", "mrs.", "ms.", "dr.", "prof.", "sir", "lady"]
SUFFIXES = ["jr.", "sr.", "ii", "iii", "iv"]
# Surnames that make a two-part name ambiguous.
COMMON_SURNAMES = [
    "smith", "johnson", "williams", "brown", "jones", "garcia", "miller", "davis",
    "rodriguez", "martinez", "hernandez", "lopez", "gonzalez", "wilson", "anderson",
    "thomas", "taylor", "moore", "jackson", "martin", "lee", "perez", "thompson",
    "white", "harris", "sanchez", "clark", "ramirez", "lewis", "robinson", "walker",
]


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(col(text)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


# English stop words of the standard analyser, and letters that fold into several or do not decompose.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on",
    "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
]
PLAIN_LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "þ": "th", "ð": "d", "ı": "i"}


def ascii_folded(text) -> Column:
    """Lower case, Latin letters without their marks; letters of other scripts stay as they are."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))[0]) for a, b in ((0xE0, 0x250), (0x1E00, 0x1F00)) for i in range(a, b)]
    pairs = [(x, y) for x, y in pairs if x != y and y.isascii()] + [(x, y) for x, y in PLAIN_LETTERS.items() if len(y) == 1]
    folded = F.translate(F.lower(col(text)), "".join(x for x, _ in pairs), "".join(y for _, y in pairs))
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), [kv for kv in PLAIN_LETTERS.items() if len(kv[1]) > 1], folded)


def analysed(text, stop: list[str] | None = None) -> Column:
    """Tokens as the name index analyses them: folded, without stop words."""
    return F.filter(tokens(ascii_folded(text)), lambda t: ~t.isin(STOP_WORDS if stop is None else stop))


def words(text) -> Column:
    return F.filter(F.split(F.trim(F.lower(col(text))), r"\s+"), lambda t: t != "")


def slug(name) -> Column:
    return F.translate(F.lower(col(name)), " -", "__")


def strip_parentheses(name) -> Column:
    return F.trim(F.regexp_replace(col(name), r"\s*\([^)]*\)", ""))


def contextual_text(name, context, description) -> Column:
    return F.trim(F.concat_ws(" ", col(name), F.coalesce(col(context), col(description))))


def article_id(title, content) -> Column:
    return F.concat(F.lit("article_"), F.left(F.md5(F.concat(col(title), col(content))), F.lit(12)))


def pair_key(query, candidate, context) -> Column:
    """One key for a judged pair: case does not matter, nor what stands behind the first 100 characters of context."""
    return F.md5(F.concat_ws("|", F.lower(col(query)), F.lower(col(candidate)), F.left(F.coalesce(col(context), F.lit("")), F.lit(100))))


def edit_similarity(a, b) -> Column:
    a, b = col(a), col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - F.levenshtein(a, b) / longest))


def auto_fuzziness(term) -> Column:
    """Edits that a term of this length may have: none up to 2 characters, one up to 5, else two."""
    n = F.length(col(term))
    return F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2)


def jaccard(a, b) -> Column:
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(x, y)))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine, not below 0; 0 if either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), dot(a, b) / norm))


def window(text, start, end, around: int = 50) -> Column:
    """The characters around text[start:end); offsets count from 0."""
    lo = F.greatest(col(start) - around, F.lit(0))
    hi = F.least(F.length(col(text)), col(end) + around)
    return F.substring(col(text), (lo + 1).cast("int"), (hi - lo).cast("int"))


def name_variations(name, most: int = 5) -> Column:
    """Other spellings to search for, best first, none equal to the name."""
    n = col(name)
    parts = F.filter(F.split(F.lower(n), r"\s+"), lambda t: t != "")
    bare = F.filter(parts, lambda t: ~t.isin(PREFIXES + SUFFIXES))
    none = F.array().cast("array<string>")
    stripped = F.when((F.size(bare) > 0) & (F.size(bare) != F.size(parts)), F.array(F.array_join(bare, " "))).otherwise(none)
    first, last = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(-1))
    split = F.when(F.size(parts) >= 2, F.array(F.concat_ws(" ", first, last), first, last)).otherwise(none)
    every = F.concat(F.array(F.lower(n), F.upper(n), F.initcap(n)), stripped, split)
    return F.slice(F.filter(F.array_distinct(every), lambda v: v != n), 1, most)


def without_honorifics(name) -> Column:
    return F.array_join(F.filter(words(name), lambda t: ~t.isin(PREFIXES + SUFFIXES)), " ")


def is_ambiguous_name(name) -> Column:
    n = col(name)
    parts = F.filter(F.split(F.trim(n), r"\s+"), lambda t: t != "")
    pair = (F.size(parts) == 2) & F.lower(F.try_element_at(parts, F.lit(2))).isin(COMMON_SURNAMES)
    single = (F.size(parts) == 1) & (F.length(n) <= 10) & ~n.rlike(r"[^\x00-\x7F]")
    return F.coalesce(pair | single, F.lit(False))


def is_non_latin(name) -> Column:
    return col(name).rlike(r"[^\x{0000}-\x{024F}]")


def has_japanese(name) -> Column:
    return col(name).rlike(r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FAF}\x{3400}-\x{4DBF}]")


def ellipsis(text, n: int) -> Column:
    t = col(text)
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("..."))).otherwise(t)


def highlight(text, term) -> Column:
    """Marks every occurrence of the term, whatever its case."""
    quoted = F.concat(F.lit("(?i)("), F.regexp_replace(col(term), r"([^\p{L}\p{N} ])", r"\\$1"), F.lit(")"))
    return F.regexp_replace(col(text), quoted, F.lit("<em>$1</em>"))


def phrase_in(term_tokens, text_tokens) -> Column:
    """Whether the tokens stand in the text next to each other and in order."""
    pad = lambda t: F.concat(F.lit(" "), F.array_join(col(t), " "), F.lit(" "))
    return F.contains(pad(text_tokens), pad(term_tokens))


def matched_share(term_tokens, text_tokens) -> Column:
    x = F.array_distinct(col(term_tokens))
    return F.size(F.array_intersect(x, col(text_tokens))) / F.size(x)


# Language editions to ask, in this order.
LANGUAGES = ["en", "ru", "ar", "zh", "ja", "ko", "hi", "es", "fr", "de"]


def language_order(detected) -> Column:
    """English, the detected language, then the others."""
    d = col(detected)
    first = F.when(d.isNotNull(), F.array(F.lit("en"), d)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(first, F.array(*[F.lit(x) for x in LANGUAGES])))
