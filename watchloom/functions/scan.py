"""One pass over a text, a character at a time: letters by longest match, structure by brackets that know strings.

The work on one text is a small loop; Spark runs it inside Arrow batches. Null texts give null.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from watchloom.functions.text import col

# --- letters -----------------------------------------------------------------------------------------------------


class Transducer:
    """Replaces the keys of a table by their values: at each place the longest key that stands there, else the character stays."""

    def __init__(self, table: dict[str, str]):
        self.root: dict = {}
        for key, value in table.items():
            node = self.root
            for c in key:
                node = node.setdefault(c, {})
            if key:
                node[""] = value

    def __call__(self, text: str) -> str:
        out, at = [], 0
        while at < len(text):
            node, end, value, here = self.root, at, None, at
            while here < len(text) and text[here] in node:
                node, here = node[text[here]], here + 1
                if "" in node:
                    end, value = here, node[""]
            out.append(text[at] if value is None else value)
            at = end if value is not None else at + 1
        return "".join(out)


def _pairs(rows: str) -> dict[str, str]:
    return dict(x.split("=") for x in rows.split())


def _kana() -> dict[str, str]:
    """Hiragana by its table of consonants and vowels, katakana 96 code points on; a small tsu doubles the consonant behind it."""
    plain = dict(zip("あいうえお", "aiueo", strict=True))
    for row, consonant in zip(("かきくけこ", "がぎぐげご", "さしすせそ", "ざじずぜぞ", "たちつてと", "だぢづでど", "なにぬねの", "はひふへほ", "ばびぶべぼ", "ぱぴぷぺぽ", "まみむめも", "らりるれろ"), ("k", "g", "s", "z", "t", "d", "n", "h", "b", "p", "m", "r"), strict=True):
        plain |= {c: consonant + v for c, v in zip(row, "aiueo", strict=True)}
    plain |= _pairs("し=shi じ=ji ち=chi ぢ=ji つ=tsu づ=zu ふ=fu や=ya ゆ=yu よ=yo わ=wa を=o ん=n ゔ=vu")
    for c in "きぎにひびぴみりしじち":
        stem = plain[c][:-1]
        glide = "" if c in "しじち" else "y"
        plain |= {c + small: stem + glide + v for small, v in zip("ゃゅょ", "auo", strict=True)}
    doubled = {"っ" + k: ("t" if v.startswith("ch") else v[0]) + v for k, v in plain.items() if v[0] not in "aiueon"}
    both = plain | doubled
    return both | {"".join(chr(ord(c) + 96) for c in k): v for k, v in both.items()} | {"ー": ""}


def _hangul() -> dict[str, str]:
    """Every syllable by its number: 19 first consonants, 21 vowels, 27 last consonants or none."""
    first = "g kk n d tt r m b pp s ss - j jj ch k t p h".replace("-", "").split(" ")
    vowel = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
    last = ["", *"k k k n n n t l k m l l l p l m p p t t ng t t k t p t".split()]
    return {chr(0xAC00 + (i * 21 + j) * 28 + k): a + b + c for i, a in enumerate(first) for j, b in enumerate(vowel) for k, c in enumerate(last)}


def _devanagari() -> dict[str, str]:
    """A consonant sounds with an a behind it, with another vowel by its sign, and alone before the stroke."""
    consonants = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह", "k kh g gh ng ch chh j jh ny t th d dh n t th d dh n p ph b bh m y r l v sh sh s h".split(), strict=True))
    vowels, signs = "a aa i ii u uu e ai o au".split(), "ािीुूेैोौ"
    out = dict(zip("अआइईउऊएऐओऔ", vowels, strict=True)) | {"ं": "n", "ः": "h"}
    for c, s in consonants.items():
        out |= {c: s + "a", c + "्": s} | {c + sign: s + v for sign, v in zip(signs, vowels[1:], strict=True)}
    return out


#: To Latin, by script: tables of letters, and rules for scripts of syllables.
SCHEMES: dict[str, dict[str, str]] = {
    "cyrillic": _pairs("а=a б=b в=v г=g д=d е=e ё=yo ж=zh з=z и=i й=y к=k л=l м=m н=n о=o п=p р=r с=s т=t у=u ф=f х=kh ц=ts ч=ch ш=sh щ=shch ъ= ы=y ь= э=e ю=yu я=ya"),
    "greek": _pairs("α=a β=v γ=g δ=d ε=e ζ=z η=i θ=th ι=i κ=k λ=l μ=m ν=n ξ=x ο=o π=p ρ=r σ=s ς=s τ=t υ=y φ=f χ=ch ψ=ps ω=o"),
    "hebrew": _pairs("א=a ב=b ג=g ד=d ה=h ו=v ז=z ח=ch ט=t י=y כ=k ך=k ל=l מ=m ם=m נ=n ן=n ס=s ע=a פ=p ף=p צ=ts ץ=ts ק=q ר=r ש=sh ת=t"),
    "arabic": _pairs("ا=a ب=b ت=t ث=th ج=j ح=h خ=kh د=d ذ=dh ر=r ز=z س=s ش=sh ص=s ض=d ط=t ظ=z ع=a غ=gh ف=f ق=q ك=k ل=l م=m ن=n ه=h و=w ي=y ى=a ة=a ء= أ=a إ=i آ=aa"),
    "kana": _kana(),
    "hangul": _hangul(),
    "devanagari": _devanagari(),
    "thai": _pairs("ก=k ข=kh ค=kh ง=ng จ=ch ช=ch ด=d ต=t ถ=th ท=th น=n บ=b ป=p ผ=ph พ=ph ฟ=f ม=m ย=y ร=r ล=l ว=w ส=s ห=h อ=o า=a ิ=i ี=i ุ=u ู=u เ=e แ=ae โ=o ะ=a ั=a ไ=ai ใ=ai"),
}


def back(scheme: dict[str, str]) -> dict[str, str]:
    """From Latin: each form goes to the first key that has it."""
    out: dict[str, str] = {}
    for native, latin in scheme.items():
        if latin:
            out.setdefault(latin, native)
    return out


def _text_function(f: Callable[[str], str], text) -> Column:
    @F.arrow_udf("string")
    def run(c: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in c.to_pylist()], pa.string())

    return run(col(text))


def transduce(text, table: dict[str, str]) -> Column:
    """The lower-cased text with the table's keys replaced, longest first, in one pass."""
    return _text_function(Transducer(table), F.lower(col(text)))


def romaji(text) -> Column:
    """Kana in Latin letters, syllable by syllable; dots between words become blanks."""
    return F.trim(F.regexp_replace(transduce(text, SCHEMES["kana"]), "[・･]", " "))


# --- brackets ----------------------------------------------------------------------------------------------------

CLOSES = {"{": "}", "[": "]", "(": ")"}


def values(text: str) -> list[str]:
    """The outermost balanced JSON objects and arrays of a text, in order. Brackets inside strings do not count, and an escaped mark does
    not end a string; marks outside of brackets are prose. An opening bracket that is never closed is passed over, so
    of an answer that was cut off the parts inside it that are whole remain."""
    stack: list[tuple[str, int, list[tuple[int, int]]]] = []
    found: list[tuple[int, int]] = []
    quoted = escaped = False
    for at, c in enumerate(text):
        if quoted:
            quoted, escaped = (quoted and (escaped or c != '"')), c == "\\" and not escaped
        elif c == '"' and stack:
            quoted = True
        elif c in "{[":
            stack.append((CLOSES[c], at, []))
        elif c in "}]" and stack and stack[-1][0] == c:
            _, start, _ = stack.pop()
            (stack[-1][2] if stack else found).append((start, at + 1))
    for _, _, inside in stack:  # never closed
        found += inside
    return [text[a:b] for a, b in sorted(found)]


def fields(text: str) -> dict[str, str] | None:
    """The fields of one saved object, ``Name(field='text', other=1.5, ...)``: strings without their quotes and escapes, all else as it
    stands. None where the text is no such object or a string in it does not end."""
    head, opened, _ = text.strip().partition("(")
    body = text.strip()[len(head) + 1 : -1]
    if not opened or not head.isidentifier() or not text.strip().endswith(")"):
        return None
    parts, depth, quote, escaped, start = [], 0, "", False, 0
    for at, c in enumerate(body):
        if quote:
            quote, escaped = ("" if c == quote and not escaped else quote), c == "\\" and not escaped
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and not depth:
            parts.append(body[start:at])
            start = at + 1
    if quote or depth:
        return None
    out = {}
    for part in [*parts, body[start:]]:
        name, sign, value = (x.strip() for x in part.partition("="))
        if not part.strip():
            continue
        if not sign or not name.isidentifier():
            return None
        if value[:1] in "'\"" and value:
            try:
                value = str(ast.literal_eval(value))
            except (SyntaxError, ValueError):
                return None
        out[name] = value
    return out


def json_values(answer) -> Column:
    """``values`` of a column: an array of JSON texts."""

    @F.arrow_udf("array<string>")
    def run(c: pa.Array) -> pa.Array:
        return pa.array([None if x is None else values(x) for x in c.to_pylist()], pa.list_(pa.string()))

    return run(col(answer))


def repr_fields(text) -> Column:
    """``fields`` of a column: a map of strings, null where the text is no saved object."""

    @F.arrow_udf("map<string,string>")
    def run(c: pa.Array) -> pa.Array:
        rows = [None if x is None else fields(x) for x in c.to_pylist()]
        return pa.array([None if r is None else list(r.items()) for r in rows], pa.map_(pa.string(), pa.string()))

    return run(col(text))
