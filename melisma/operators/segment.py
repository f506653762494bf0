"""Segmentation of verses: cutting by ranked accents, custom groups, and merging of what no one speaks.

Cutting is a narrow operation on the ranks of one verse, so it runs as an Arrow-batched UDF without any shuffle; all other
steps are expressions over the verse's arrays. A verse table keyed by (doc_id, verse) of any size is processed in place.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melisma.functions import text as T


def cut_ranges(ranks: list[int | None], most: int) -> list[tuple[int, int]]:
    """Ranges (first, last) of at most ``most`` words. A longer range is cut after the word (not its last) of the least
    rank, the one nearest the middle of equals, the first of these; without any rank, in half."""
    places: dict[int, list[int]] = {}
    for i, r in enumerate(ranks):
        if r is not None:
            places.setdefault(r, []).append(i)
    by_rank = sorted(places.items())
    out, open_ranges = [], [(0, len(ranks) - 1)] if ranks else []
    while open_ranges:
        lo, hi = open_ranges.pop()
        n = hi - lo + 1
        if n <= most:
            out.append((lo, hi))
            continue
        at = lo + n // 2 - 1
        for _, p in by_rank:
            k = bisect.bisect_right(p, (lo + hi) // 2)
            near = [i for i in p[max(0, k - 1) : k + 1] if lo <= i < hi]
            if near:
                at = min(near, key=lambda i: (abs(2 * i - lo - hi), i))
                break
        open_ranges += [(at + 1, hi), (lo, at)]  # the left part first
    return out


def join_silent(ranges: list[tuple[int, int]], speaks: list[bool]) -> list[tuple[int, int]]:
    """Neighbouring ranges of a verse joined so that each has a spoken word: a silent one joins the one before it, leading
    ones the next; none are left if nothing is spoken."""
    out: list[tuple[int, int]] = []
    start = ranges[0][0] if ranges else 0
    for lo, hi in ranges:
        if any(speaks[lo : hi + 1]):
            out.append((lo if out else start, hi))
        elif out:
            out[-1] = (out[-1][0], hi)
    return out


def split_unit(ranks: Column, most: int = 4, speaks: Column | None = None) -> Column:
    """array<struct<lo,hi>> for the words' ranks of a verse; with ``speaks``, silent ranges are joined to their neighbours."""
    if most < 1:
        raise ValueError("most must be 1 at least")

    def cut(r) -> list[tuple[int, int]]:
        return cut_ranges([None if v is None or v != v else int(v) for v in r.tolist()], most)

    def cells(ranges: list[tuple[int, int]]) -> list[dict]:
        return [{"lo": a, "hi": b} for a, b in ranges]

    kind = "array<struct<lo:int,hi:int>>"
    if speaks is None:

        @F.pandas_udf(kind)
        def run(x: pd.Series) -> pd.Series:
            return x.map(lambda r: [] if r is None else cells(cut(r)))

        return run(ranks)

    @F.pandas_udf(kind)
    def run_joined(x: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([[] if r is None else cells(join_silent(cut(r), k.tolist())) for r, k in zip(x, s, strict=True)], dtype=object)

    return run_joined(ranks, speaks)


def word_ranks(words: Column, poetic: Column) -> Column:
    """Ranks of a verse's words; the system is chosen once, outside the functions of a word."""
    return F.when(poetic, F.transform(words, lambda w: T.word_rank(w, True))).otherwise(F.transform(words, lambda w: T.word_rank(w, False)))


def best_cut_index(ranks: Column) -> Column:
    """The word after which a range is cut first; null if no word but the last has a rank. A native expression."""
    n = F.size(ranks)
    places = F.transform(F.slice(ranks, 1, F.greatest(n - 1, F.lit(0))), lambda r, i: F.struct(r.alias("rank"), F.abs(2 * i - (n - 1)).alias("away"), i.alias("i")))
    return F.array_min(F.filter(places, lambda p: p["rank"].isNotNull()))["i"]


def build_segment(words: Column) -> tuple[Column, Column, Column]:
    """Display text and the pointed and plain spoken words of a segment."""
    return F.array_join(words, " "), _spoken(words, True), _spoken(words, False)


def _spoken(words: Column, pointed: bool) -> Column:
    return F.flatten(F.transform(words, lambda w: T.spoken_words(w, pointed)))


def cut_verses(verses: DataFrame, most: int = 4, text: str = "text", join: bool = False) -> DataFrame:
    """The verse rows with words and ranges: clean, tokenise, choose the accent system of the verse, cut; with ``join``,
    ranges without spoken words join their neighbours. A narrow operation: no row leaves its partition."""
    worded = verses.withColumn("words", T.tokens(T.clean_text(F.col(text))))
    ranks = word_ranks(F.col("words"), T.is_poetic(F.array_join("words", " ")))
    speaks = F.transform("words", lambda w: F.exists(F.split(w, T.MAQAF), lambda p: p.rlike(T.LETTERS) & p.rlike(T.POINTS)))
    return worded.withColumn("ranges", split_unit(ranks, most, speaks if join else None))


def _exploded(verses: DataFrame, keys: list[str], most: int, text: str, join: bool) -> DataFrame:
    cut = cut_verses(verses.select(*keys, text), most, text, join)
    # the outer form keeps the optimiser from inferring a filter that would run the functions of the ranges twice
    rows = cut.select(*keys, "words", F.posexplode_outer("ranges").alias("seg_ix", "r")).where("seg_ix IS NOT NULL")
    return rows.select(*keys, "seg_ix", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"), F.slice("words", F.col("r.lo") + 1, F.col("r.hi") - F.col("r.lo") + 1).alias("words"))


def verse_segments(verses: DataFrame, keys: list[str], most: int = 4, text: str = "text") -> DataFrame:
    """keys, seg_ix, lo, hi, words of all segments of all verses."""
    return _exploded(verses, keys, most, text, False)


def segments_for_pipeline(verses: DataFrame, keys: list[str], most: int = 4, text: str = "text") -> DataFrame:
    """keys, seg_ix, display, align_vocalized, align_plain; segments without spoken words merged within the verse.

    Segments of a verse are neighbouring ranges of its words, so merging them is joining ranges, before any row is made."""
    display, pointed, plain = build_segment(F.col("words"))
    return _exploded(verses, keys, most, text, True).select(*keys, "seg_ix", display.alias("display"), pointed.alias("align_vocalized"), plain.alias("align_plain"))


def merge_unalignable(segments: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """A segment without spoken words joins the kept one before it, leading ones the next; if none speaks, all go.

    Spoken lists and the columns of ``keep`` are those of the segment that speaks. seg_ix is numbered anew from 0."""
    speaks = F.size("align_vocalized") > 0
    running = F.sum(speaks.cast("int")).over(Window.partitionBy(*keys).orderBy("seg_ix").rowsBetween(Window.unboundedPreceding, 0))
    grouped = segments.withColumn("_group", F.greatest(F.lit(1), running)).groupBy(*keys, "_group")
    parts = grouped.agg(
        F.array_sort(F.collect_list(F.struct("seg_ix", "display"))).alias("_d"),
        *[F.max_by(F.when(speaks, F.col(c)), F.when(speaks, F.col("seg_ix"))).alias(c) for c in ("align_vocalized", "align_plain", *keep)],
        F.bool_or(speaks).alias("_speaks"),
    )
    kept = parts.where("_speaks")
    return kept.select(*keys, (F.col("_group") - 1).cast("int").alias("seg_ix"), F.array_join(F.transform("_d", lambda d: d["display"]), " ").alias("display"), "align_vocalized", "align_plain", *keep)


def regroup_words(words: DataFrame, splits: DataFrame, keys: list[str]) -> DataFrame:
    """Custom groups: words (keys, word_ix from 0, word, verse) by sizes (keys, seg_ix, size).

    Fails if a size is below one or the sizes of a key do not add up to its words. The verse of a segment is that of its
    first word. Sizes are exploded to the positions they cover, so that each word meets one row."""
    total = splits.groupBy(*keys).agg(F.sum("size").alias("_total"), F.min("size").alias("_least"))
    count = words.groupBy(*keys).agg(F.count("*").alias("_count"))
    checked = total.join(count, keys, "full").select(*keys, F.when((F.coalesce("_total", F.lit(-1)) != F.coalesce("_count", F.lit(0))), F.raise_error(F.format_string("sizes cover %d words, the text has %d", F.coalesce("_total", F.lit(0)), F.coalesce("_count", F.lit(0))))).when(F.col("_least") < 1, F.raise_error(F.lit("every segment needs a word at least"))).otherwise(True).alias("_ok"))
    upto = F.sum("size").over(Window.partitionBy(*keys).orderBy("seg_ix").rowsBetween(Window.unboundedPreceding, 0))
    ranges = splits.select(*keys, "seg_ix", (upto - F.col("size")).alias("_lo"), upto.alias("_hi")).join(checked, keys).where("_ok")
    covered = ranges.select(*keys, "seg_ix", F.explode(F.sequence(F.col("_lo").cast("int"), F.col("_hi").cast("int") - 1)).alias("word_ix"))
    inside = words.join(covered, [*keys, "word_ix"])
    ordered = inside.groupBy(*keys, "seg_ix").agg(F.array_sort(F.collect_list(F.struct("word_ix", "word", "verse"))).alias("_w"))
    display, pointed, plain = build_segment(F.transform("_w", lambda w: w["word"]))
    built = ordered.select(*keys, "seg_ix", display.alias("display"), pointed.alias("align_vocalized"), plain.alias("align_plain"), F.col("_w")[0]["verse"].alias("verse"))
    return merge_unalignable(built, keys, ("verse",))


def verses_to_segments(verses: DataFrame, keys: list[str], most: int = 4, splits: DataFrame | None = None) -> DataFrame:
    """Segments with their verse numbers (``verse`` in the input), cut by accents or, across verses, by given sizes."""
    if splits is None:
        out = segments_for_pipeline(verses, [*keys, "verse"], most)
        w = Window.partitionBy(*keys).orderBy("verse", "seg_ix")
        return out.withColumn("seg_ix", F.row_number().over(w) - 1)
    worded = verses.select(*keys, "verse", F.posexplode(T.tokens(T.clean_text(F.col("text")))).alias("_i", "word"))
    w = Window.partitionBy(*keys).orderBy("verse", "_i")
    return regroup_words(worded.withColumn("word_ix", F.row_number().over(w) - 1), splits, keys)


def payload_segments(segments: DataFrame, keys: list[str], first_verse: int = 1) -> DataFrame:
    """What the text service returns for each segment: display, verse label, spoken words, their letters and end of verse.

    ``segments`` has keys, verse (1-based), seg_ix, display and align_plain."""
    last = Window.partitionBy(*keys, "verse").orderBy(F.desc("seg_ix"))
    letters = F.aggregate("align_plain", F.lit(0), lambda n, w: n + F.length(w))
    return segments.select(*keys, "seg_ix", "display", (F.col("verse") + (first_verse - 1)).alias("verse"), F.size("align_plain").alias("words"), letters.alias("letters"), (F.row_number().over(last) == 1).alias("verse_end"))
