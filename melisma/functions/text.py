"""Text functions over columns: cleaning, tokens, accents, spoken forms, clocks.

All work on code points and run inside the JVM, except canonical composition and the resolution of character references,
which Spark lacks and an Arrow-batched UDF supplies.
"""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Accents by rank in the two systems, servants, markers and points, as code points.
PROSE_RANKS = {1: "׃֑", 2: "֖֒֓֔֕", 3: "֛֚֮֗֘֙", 4: "֜֞֟֠֡"}
POETIC_RANKS = {1: "׃֫", 2: "֑", 3: "֭֮֗֓", 4: "֡"}
SERVANTS = "֣֤֥֦֧֪֨֩֝"
POETIC_MARKERS = "֢֭֫֬"
METEG, MAQAF, PASEQ, SOF_PASUQ = "ֽ", "־", "׀", "׃"
LETTERS = "[א-ת]"
POINTS = "[ְ-ׇֽֿׁׂ]"
INVISIBLE = "[‎‏​⁠﻿­]"
# A name that is read as another word, and its pointed form.
NAME, READ_AS, READ_AS_POINTED = "יהוה", "אדני", "אֲדֹנָי"
# Final letters and their ordinary forms; a spelling that speech recognition prefers.
FINALS, ORDINARY = "ךםןףץ", "כמנפצ"
HEARD_AS = "אדוני"

ACCENTS = "".join(dict.fromkeys("".join(PROSE_RANKS.values()) + SERVANTS + POETIC_MARKERS + PASEQ))
#: White space as Unicode has it; Java's \\s is ASCII only.
SPACE = "[\\s\u0085   -     　\u001c-\u001f]"


@F.pandas_udf(StringType())
def nfc(x: pd.Series) -> pd.Series:
    """Canonical composition."""
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def unescape(x: pd.Series) -> pd.Series:
    """Character references resolved as in HTML 5."""
    return x.map(lambda t: None if t is None else html.unescape(t))


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([A-Za-z][A-Za-z0-9]*));")


@F.pandas_udf(StringType())
def unescape_closed(x: pd.Series) -> pd.Series:
    """Character references resolved where a semicolon ends them."""

    def one(m: re.Match) -> str:
        return html.unescape(m[0]) if m[1] is None or m[1] + ";" in html.entities.html5 else m[0]

    return x.map(lambda t: None if t is None else _CLOSED.sub(one, t))


def fixed(x: Column, places: int, width: int = 0) -> Column:
    """Decimal places as text, right-aligned in ``width``, rounded by the exact binary value as C and Python do (Java
    rounds the decimal form); null for null and for what is no number."""

    @F.pandas_udf(StringType())
    def shown(v: pd.Series) -> pd.Series:
        return v.map(lambda n: None if n is None or n != n else f"{n:{width}.{places}f}")

    return shown(x.cast("double"))


def rounded(x: Column, places: int) -> Column:
    """The number nearest to x with so many decimal places, by the exact binary value."""
    return fixed(x, places).cast("double")


def two_places(x: Column) -> Column:
    return fixed(x, 2)


def strip(x: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def trim_space(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, SPACE + "+", " "), "^ | $", "")


def clean_text(x: Column, closed: bool = False) -> Column:
    """Composed text without footnotes, tags, section marks and invisible characters, with single spaces.

    Footnotes and line breaks become a space, other tags vanish; references are resolved after the tags are gone, those
    without a semicolon as in HTML 5 or, if ``closed``, not at all: a text cut inside a reference keeps what is left of it,
    and the removed tags do not make it one with the letters that follow."""
    x = nfc(x)
    x = F.regexp_replace(x, '(?is)<sup[^>]*>.*?</sup>|<i\\s+class="footnote"[^>]*>.*?</i>', " ")
    x = F.regexp_replace(x, "(?i)<br\\s*/?>", " ")
    x = (unescape_closed if closed else unescape)(F.regexp_replace(x, "<[^>]+>", ""))
    x = F.regexp_replace(x, "[{(]" + SPACE + "*[פס]" + SPACE + "*[})]", " ")
    x = F.regexp_replace(x, INVISIBLE, "")
    return trim_space(x)


def tokens(clean: Column) -> Column:
    """Words of a clean verse: pieces between spaces that hold a letter."""
    return F.filter(F.split(clean, " "), lambda t: t.rlike(LETTERS))


def letters_only(word: Column) -> Column:
    return F.regexp_replace(word, "[^א-ת]", "")


def word_accents(word: Column) -> Column:
    """The distinct accents of a word in order of appearance; the meteg is a point, not an accent."""
    return F.array_distinct(F.regexp_extract_all(word, F.lit(f"([{ACCENTS}])"), 1))


def word_rank(word: Column, poetic: bool = False) -> Column:
    """The least rank of a word's dividing accents in the chosen system; null if it has none."""
    ranks, out = POETIC_RANKS if poetic else PROSE_RANKS, F.lit(None).cast("int")
    for rank in sorted(ranks, reverse=True):
        out = F.when(word.rlike(f"[{ranks[rank]}]"), rank).otherwise(out)
    return out


def is_poetic(verse: Column) -> Column:
    """Whether any word of a verse has a mark that only the poetic system uses."""
    return verse.rlike(f"[{POETIC_MARKERS}]")


def is_ketiv(word: Column) -> Column:
    """Written but not read: letters without any point."""
    return word.rlike(LETTERS) & ~word.rlike(POINTS)


def strip_accents(word: Column) -> Column:
    return trim_space(F.regexp_replace(word, f"[֑-֯{PASEQ}{METEG}{SOF_PASUQ}]", ""))


def spoken_words(word: Column, pointed: bool) -> Column:
    """The words a reader speaks for a written word: joined words apart, unread ones left out, the name as it is read."""
    pieces = F.filter(F.split(word, MAQAF), lambda p: p.rlike(LETTERS) & p.rlike(POINTS))

    def read(p: Column) -> Column:
        plain = letters_only(p)
        return F.when(plain == NAME, READ_AS_POINTED if pointed else READ_AS).otherwise(strip_accents(p) if pointed else plain)

    return F.transform(pieces, read)


def normalize_word(word: Column, composed: bool = False) -> Column:
    """Letters only, finals as ordinary letters, and the usual misspelling of the name mended."""
    plain = F.translate(letters_only(word if composed else nfc(word)), FINALS, ORDINARY)
    return F.when(plain == HEARD_AS, READ_AS).otherwise(plain)


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm of seconds, rounded half to even, not below zero."""
    ms = F.greatest(F.lit(0).cast("long"), F.bround(seconds * 1000).cast("long"))
    h, m, s, r = (ms / 3_600_000).cast("long"), (ms / 60_000).cast("long") % 60, (ms / 1000).cast("long") % 60, ms % 1000
    return F.format_string("%02d:%02d:%02d,%03d", h, m, s, r)


def clock(seconds: Column) -> Column:
    """[mm:ss]; minutes may exceed 99."""
    whole = seconds.cast("long")
    return F.format_string("[%02d:%02d]", F.floor(whole / 60).cast("long"), whole % 60)


def text_weight(letters: Column, verse_end: Column) -> Column:
    """Letters (none: one) plus two, and five more at the end of a verse."""
    n = F.when(F.coalesce(letters, F.lit(0)) == 0, 1).otherwise(letters)
    return n + 2 + F.when(F.coalesce(verse_end, F.lit(False)), 5).otherwise(0)


def upper_median(values: Column) -> Column:
    """Element n div 2 of the sorted values; null without values."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))
