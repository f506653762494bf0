"""Requests: references, versions, validation of form fields. Every rule is a column, so tables of requests of any size
are checked in one pass; the first rule that fails names the error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melisma.dims import NAMES, books
from melisma.functions import text as T

# Words by which a version's title is recognised, in order of preference; limits of fields.
FIRST, SECOND = ("masorah", "מסורה"), ("ta'amei hamikra", "טעמי המקרא")
MAX_SPLIT_WORDS, WORDS_DEFAULT, WORDS_RANGE, API_RANGE, MAX_UPLOAD = 20_000, 4, (1, 10), (2, 8), 300 * 1024 * 1024


def pick_version(versions: DataFrame, key: str = "book", language: str = "he") -> DataFrame:
    """key, version: of the versions in the language the first with a preferred title; null if none has one.

    versions: key, pos, language, version_title."""
    low = F.lower(F.col("version_title"))
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    rank = F.when(F.col("language") != language, None).when(has(FIRST), 1).when(has(SECOND), 2)
    return versions.groupBy(key).agg(F.min_by("version_title", F.when(rank.isNotNull(), F.struct(rank.alias("r"), F.col("pos")))).alias("version"))


def number_verses(texts: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """Non-blank verses numbered from 1 in order; blank ones leave no gap."""
    w = Window.partitionBy(key).orderBy(order)
    return texts.where(F.length(T.trim_space(F.col(text))) > 0).select(key, F.row_number().over(w).alias("verse"), F.col(text).alias("text"))


def build_ref(book: Column, chapter: Column, verse: Column, chapter_end: Column, verse_end: Column) -> Column:
    """``B c``, ``B c:v``, ``B c:v-w`` or ``B c:v-d:w``; ends count only with a first verse, a missing last verse is 1."""
    start = F.concat(book, F.lit(" "), chapter.cast("string"))
    has = lambda c: F.coalesce(c, F.lit(0)) != 0
    far = F.concat(start, F.lit(":"), verse.cast("string"), F.lit("-"), chapter_end.cast("string"), F.lit(":"), F.when(has(verse_end), verse_end).otherwise(1).cast("string"))
    near = F.concat(start, F.lit(":"), verse.cast("string"), F.lit("-"), verse_end.cast("string"))
    return F.when(~has(verse), start).when(has(chapter_end) & (chapter_end != chapter), far).when(has(verse_end), near).otherwise(F.concat(start, F.lit(":"), verse.cast("string")))


def to_english(book: Column) -> Column:
    """The English title of a known name, any other name trimmed. The names are a fixed map of a few dozen entries."""
    name = T.strip(F.coalesce(book, F.lit("")))
    known = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), name)


def is_known(book: Column) -> Column:
    return T.strip(F.coalesce(book, F.lit(""))).isin(list(NAMES))


def book_titles(requests: DataFrame, book: str = "book") -> DataFrame:
    """The rows with section and place of the book, by a join with the fixed table of books (39 rows)."""
    dim = books(requests.sparkSession).select(F.col("en").alias("_title"), "section", "ord")
    return requests.withColumn("_title", to_english(F.col(book))).join(F.broadcast(dim), "_title", "left").drop("_title")


#: Digits may be grouped by single underscores.
_INTEGER = "^[+-]?[0-9]+(_[0-9]+)*$"


def read_int(raw: Column, required: bool = False) -> tuple[Column, Column]:
    """Value and error of a query field: blank is null (an error if required), then whole numbers from 1 on."""
    t = T.strip(F.coalesce(raw, F.lit("")))
    n = F.when(t.rlike(_INTEGER), F.replace(t, F.lit("_"), F.lit("")).try_cast("long"))
    error = F.when(t == "", F.lit("missing") if required else F.lit(None)).when(~t.rlike(_INTEGER) | n.isNull(), "not a number").when(n < 1, "below one")
    return F.when(error.isNull(), n), error


def int_or_none(raw: Column, least: int = 1) -> tuple[Column, Column]:
    """Value and error of a form field: null, blank and 0 are null, then whole numbers from ``least`` on."""
    t = T.strip(F.coalesce(raw, F.lit("")))
    n = F.when(t.rlike(_INTEGER), F.replace(t, F.lit("_"), F.lit("")).try_cast("long"))
    error = F.when(t.isin("", "0"), None).when(n.isNull(), "not a number").when(n < least, "too small")
    return F.when(error.isNull() & ~t.isin("", "0"), n), error


def parse_splits(raw: Column) -> tuple[Column, Column]:
    """Sizes and error: a JSON list of whole numbers from 1 on with a sum within the limit; blank is null."""
    t = T.strip(F.coalesce(raw, F.lit("")))
    # outside the list only the white space that JSON knows may stand
    shaped = raw.rlike(r"^[ \t\n\r]*\[\s*-?(0|[1-9][0-9]*)(\s*,\s*-?(0|[1-9][0-9]*))*\s*\][ \t\n\r]*$")
    sizes = F.when(shaped, F.from_json(t, "array<long>"))
    error = F.when(t == "", None).when(~shaped | F.exists(sizes, lambda x: x.isNull()), "malformed").when(F.exists(sizes, lambda x: x < 1), "empty segment").when(F.aggregate(sizes, F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)")) > MAX_SPLIT_WORDS, "too long")
    return F.when(error.isNull() & (t != ""), sizes), error


def parse_push(raw: Column) -> Column:
    """A push subscription (endpoint, p256dh, auth), null for anything that is not one."""
    s = F.from_json(raw, "endpoint string, keys struct<p256dh:string,auth:string>")
    ok = s["endpoint"].startswith("https://") & (F.length(s["keys"]["p256dh"]) > 0) & (F.length(s["keys"]["auth"]) > 0)
    return F.when(ok, F.struct(s["endpoint"].alias("endpoint"), s["keys"]["p256dh"].alias("p256dh"), s["keys"]["auth"].alias("auth")))


def parse_params(requests: DataFrame, keys: list[str]) -> DataFrame:
    """keys, the parsed job parameters, and ``error``: the first rule that fails, null if the request is valid."""
    chapter, e1 = int_or_none(F.col("chapter"))
    start, e2 = int_or_none(F.col("verse_start"))
    end, e3 = int_or_none(F.col("verse_end"))
    last, e4 = int_or_none(F.col("chapter_end"))
    words, e5 = int_or_none(F.col("max_words"))
    sizes, e6 = parse_splits(F.col("splits"))
    words = F.coalesce(words, F.lit(WORDS_DEFAULT))
    error = F.coalesce(
        F.when(T.strip(F.coalesce("book", F.lit(""))) == "", "book: missing"),
        F.when(~is_known(F.col("book")), "book: unknown"),
        F.concat(F.lit("chapter: "), e1),
        F.when(chapter.isNull(), "chapter: missing"),
        F.concat(F.lit("verse_start: "), e2),
        F.concat(F.lit("verse_end: "), e3),
        F.concat(F.lit("chapter_end: "), e4),
        F.when(last < chapter, "chapter_end: before chapter"),
        F.when(last.isNull() & (end < start), "verse_end: before verse_start"),
        F.concat(F.lit("max_words: "), e5),
        F.when((words < WORDS_RANGE[0]) | (words > WORDS_RANGE[1]), "max_words: out of range"),
        F.concat(F.lit("splits: "), e6),
    )
    return requests.select(*keys, T.strip(F.col("book")).alias("book"), chapter.alias("chapter"), start.alias("verse_start"), end.alias("verse_end"), last.alias("chapter_end"), words.alias("max_words"), sizes.alias("splits"), error.alias("error"))


def check_upload(size: Column, name: Column) -> tuple[Column, Column]:
    """HTTP status (200, 400 empty, 413 too large) and the suffix that is kept: a safe one, else ``.m4a``."""
    suffix = F.regexp_extract(name, r"(\.[^./]*)$", 1)
    return F.when(size == 0, 400).when(size > MAX_UPLOAD, 413).otherwise(200), F.when(suffix.rlike(r"^\.[A-Za-z0-9]{1,8}$"), suffix).otherwise(".m4a")


def api_max_words(n: Column) -> Column:
    """The text service's limit: 4 if absent, drawn into its range."""
    return F.least(F.greatest(F.coalesce(n, F.lit(WORDS_DEFAULT)), F.lit(API_RANGE[0])), F.lit(API_RANGE[1]))
