"""Confidence of segments, reports, and evaluation of timing methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melisma.functions import text as T

# Weights of the four signals, cap of interpolated segments, distances at which a signal has faded.
W_SCORE, W_ANCHOR, W_HEARD, W_VOICE = 0.35, 0.25, 0.2, 0.2
CAP, ANCHOR_FAR, HEARD_NEAR, HEARD_FAR, LOW_SCORE, LOW = 0.3, 50.0, 0.5, 2.0, 0.2, 0.5
# The report's wording.
REASONS = {
    "interpolated": "זמן משוער (יישור נכשל בחלון)",
    "anchor": "אין עוגן ASR בקרבת מקום",
    "gap": "פער ASR/CTC ‏%s שניות",
    "voice": "הגבול באמצע דיבור (לא הוצמד לנשימה)",
    "score": "ציון יישור נמוך",
}
TITLE, RULE = "דוח איכות הסנכרון", "=" * 40
SUMMARY = "מקטעים: %d | ביטחון חציוני: %s | לבדיקה ידנית: %d"
ALL_WELL, LOW_ONES = "כל המקטעים בביטחון סביר — ייבא ל-CapCut ובדוק בעין.", "מקטעים בביטחון נמוך (<%s) — מומלץ לגרור ידנית:"
# The comparison's title, heading and goal.
COMPARISON = "השוואת שיטות סנכרון"
COMPARISON_HEAD = f"{'שיטה':<24} {'בטווח 0.5s':>10} {'בטווח 1.0s':>10} {'חציון':>8} {'מקס':>8} {'מקדים':>6} {'מאחר':>6}"
COMPARISON_GOAL = "יעד: ‏~90% בטווח 1 שנייה, ובפער משמעותי מעל ה-baseline."
ENTRY, BECAUSE = "  %s פסוק %s | ביטחון %s | %s", "        סיבה: %s"


def word_ranges(segments: DataFrame, key: str = "rec_id") -> DataFrame:
    """key, seg_ix, lo, hi: positions of a segment's words, both inclusive. segments: key, seg_ix, n_words."""
    upto = F.sum("n_words").over(Window.partitionBy(key).orderBy("seg_ix").rowsBetween(Window.unboundedPreceding, 0))
    return segments.select(key, "seg_ix", (upto - F.col("n_words")).alias("lo"), (upto - 1).alias("hi"))


def verse_start_flags(segments: DataFrame, key: str = "rec_id") -> DataFrame:
    """key, seg_ix, opens_verse: the verse differs from that of the segment before."""
    w = Window.partitionBy(key).orderBy("seg_ix")
    first = F.row_number().over(w) == 1
    return segments.select(key, "seg_ix", (first | ~F.col("verse").eqNullSafe(F.lag("verse").over(w))).alias("opens_verse"))


def anchor_distances(ranges: DataFrame, anchors: DataFrame, key: str = "rec_id") -> DataFrame:
    """key, seg_ix, anchor_dist: words from the range to the nearest anchor, 0 inside, null without anchors.

    An as-of join over one ordering: the nearest anchor at or before the end of the range and the nearest at or after its
    start decide."""
    r = ranges.select(key, "seg_ix", "lo", "hi")
    none = F.lit(None).cast("long")
    points = anchors.select(key, F.col("ref").cast("long").alias("at"), F.lit(1).alias("kind"), none.alias("seg_ix"), F.col("ref").cast("long").alias("ref"))
    ends = r.select(key, F.col("hi").cast("long").alias("at"), F.lit(2).alias("kind"), F.col("seg_ix").cast("long").alias("seg_ix"), none.alias("ref"))
    begins = r.select(key, F.col("lo").cast("long").alias("at"), F.lit(0).alias("kind"), F.col("seg_ix").cast("long").alias("seg_ix"), none.alias("ref"))
    w = Window.partitionBy(key).orderBy("at", "kind")
    all_points = points.unionByName(ends).unionByName(begins)
    near = all_points.withColumn("before", F.last("ref", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.first("ref", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    found = near.where("kind != 1").groupBy(key, "seg_ix").agg(F.max(F.when(F.col("kind") == 2, F.col("before"))).alias("before"), F.min(F.when(F.col("kind") == 0, F.col("after"))).alias("after"))
    zero = F.lit(0).cast("long")
    return r.join(found, [key, "seg_ix"]).select(key, "seg_ix", F.least(F.when(F.col("before").isNotNull(), F.greatest(zero, F.col("lo") - F.col("before"))), F.when(F.col("after").isNotNull(), F.greatest(zero, F.col("after") - F.col("hi")))).alias("anchor_dist"))


def places(ranges: DataFrame, key: str = "rec_id") -> DataFrame:
    """The ranges exploded to word positions, so that joins on them are equi-joins."""
    return ranges.where("hi >= lo").select(key, "seg_ix", F.explode(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int"))).alias("word_ix"))


def heard_gaps(ranges: DataFrame, matches: DataFrame, spans: DataFrame, key: str = "rec_id") -> DataFrame:
    """key, seg_ix, asr_gap: upper median of the distances between heard and aligned starts; null without matches.
    Of several matches of a word the last (in ``k`` order) counts. matches: key, ref, asr_start, k."""
    last = matches.groupBy(key, F.col("ref").alias("word_ix")).agg(F.max_by("asr_start", "k").alias("asr_start"))
    gaps = places(ranges, key).join(last, [key, "word_ix"]).join(spans.select(key, "word_ix", "start"), [key, "word_ix"])
    found = gaps.groupBy(key, "seg_ix").agg(T.upper_median(F.collect_list(F.abs(F.col("asr_start") - F.col("start")))).alias("asr_gap"))
    return ranges.select(key, "seg_ix").join(found, [key, "seg_ix"], "left")


def segment_signals(ranges: DataFrame, spans: DataFrame, key: str = "rec_id") -> DataFrame:
    """key, seg_ix, ctc_score (mean) and interpolated (any) of a segment's words."""
    return places(ranges, key).join(spans, [key, "word_ix"]).groupBy(key, "seg_ix").agg(F.avg("score").alias("ctc_score"), F.bool_or("interpolated").alias("interpolated"))


def confidence(score: Column, anchor_dist: Column, gap: Column, snapped: Column, interpolated: Column) -> Column:
    """Weighted confidence of a segment, rounded to three places; a missing signal has its own neutral value."""
    a = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), F.lit(0.5))
    b = F.coalesce(F.greatest(F.lit(0.0), 1 - anchor_dist / ANCHOR_FAR), F.lit(0.0))
    fading = F.greatest(F.lit(0.0), 1 - (gap - HEARD_NEAR) / (HEARD_FAR - HEARD_NEAR))
    c = F.when(gap.isNull(), 0.5).when(gap <= HEARD_NEAR, 1.0).otherwise(fading)
    d = F.when(snapped.isNull(), 0.5).when(snapped, 1.0).otherwise(0.4)
    total = W_SCORE * a + W_ANCHOR * b + W_HEARD * c + W_VOICE * d
    return T.rounded(F.when(F.coalesce(interpolated, F.lit(False)), F.least(F.lit(CAP), total)).otherwise(total), 3)


def reasons(score: Column, anchor_dist: Column, gap: Column, snapped: Column, interpolated: Column) -> Column:
    """What speaks against a segment, joined; a dash if nothing does."""
    found = F.array_compact(
        F.array(
            F.when(F.coalesce(interpolated, F.lit(False)), REASONS["interpolated"]),
            F.when(anchor_dist.isNull() | (anchor_dist >= ANCHOR_FAR), REASONS["anchor"]),
            F.when(gap > HEARD_FAR, F.format_string(REASONS["gap"], T.fixed(gap, 1))),
            F.when(~snapped, REASONS["voice"]),
            F.when(score < LOW_SCORE, REASONS["score"]),
        )
    )
    return F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise("—")


def report(segments: DataFrame, key: str = "rec_id", low: float = LOW) -> DataFrame:
    """key, report: the text for each recording. segments: key, seg_ix, verse, start, display, confidence, reasons."""
    entry = F.concat(F.format_string(ENTRY, T.clock(F.col("start")), F.coalesce(F.col("verse").cast("string"), F.lit("?")), F.col("_shown"), F.col("display")), F.lit("\n"), F.format_string(BECAUSE, F.col("reasons")))
    is_low = F.col("confidence") < low
    x = segments.withColumn("_shown", T.two_places(F.col("confidence"))).groupBy(key).agg(
        F.count("*").alias("n"),
        T.upper_median(F.collect_list("confidence")).alias("mid"),
        F.count_if(is_low).alias("low"),
        F.array_sort(F.collect_list(F.when(is_low, F.struct("seg_ix", entry.alias("e"))))).alias("es"),
    )
    listed = F.concat(F.lit(LOW_ONES % low + "\n"), F.array_join(F.transform("es", lambda e: e["e"]), "\n"))
    return x.select(key, F.concat(F.lit(f"{TITLE}\n{RULE}\n"), F.format_string(SUMMARY, F.col("n"), T.two_places(F.col("mid")), F.col("low")), F.lit("\n\n"), F.when(F.col("low") > 0, listed).otherwise(ALL_WELL)).alias("report"))


def boundary_errors(predicted: DataFrame, truth: DataFrame, keys: list[str] = ("method",)) -> DataFrame:
    """keys, seg_ix, error (predicted less true). Fails unless both sides have the same boundaries."""
    keys = list(keys)
    p = predicted.select(*keys, "seg_ix", F.col("start").alias("_p"))
    both = p.join(truth.select("seg_ix", F.col("start").alias("_t")), "seg_ix", "left")
    sizes = p.groupBy(*keys).agg(F.count("*").alias("_n"))
    whole = truth.agg(F.count("*").alias("_m"))
    ok = sizes.join(F.broadcast(whole)).select(*keys, F.when(F.col("_n") == F.col("_m"), True).otherwise(F.raise_error(F.format_string("%d predicted boundaries against %d true ones", "_n", "_m"))).alias("_ok"))
    return both.join(ok, keys).where("_ok").select(*keys, "seg_ix", (F.col("_p") - F.col("_t")).alias("error"))


def error_metrics(errors: DataFrame, keys: list[str] = ("method",)) -> DataFrame:
    """n, median_abs (upper), max_abs, pct_within_05, pct_within_10, early and late of each group."""
    size, e = F.abs(F.col("error")), F.col("error")
    totals = errors.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.max(size).alias("max_abs"),
        (100.0 * F.count_if(size <= 0.5) / F.count("*")).alias("pct_within_05"),
        (100.0 * F.count_if(size <= 1.0) / F.count("*")).alias("pct_within_10"),
        F.count_if(e < -0.2).alias("early"),
        F.count_if(e > 0.2).alias("late"),
    )
    return totals.join(_upper_medians(errors.select(*keys, size.alias("x")), list(keys)), list(keys)).select(*keys, "n", "median_abs", "max_abs", "pct_within_05", "pct_within_10", "early", "late")


def _upper_medians(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, median_abs: element n div 2 of the sorted values ``x`` (not below zero) of each group.

    Equal values are counted first. Bins of a logarithmic scale, some ten thousand at most, tell in which one the place
    lies, and only that one's values are put in order, so no group meets in one task."""
    counts = values.groupBy(*keys, "x").agg(F.count("*").alias("c")).withColumn("bin", F.floor(F.log2(F.col("x") + 1e-9) * 256))
    bins = counts.groupBy(*keys, "bin").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("bin"))
    place = F.floor(F.sum("c").over(Window.partitionBy(*keys)) / 2)
    chosen = bins.select(*keys, "bin", upto.alias("upto"), place.alias("place"), "c").where("place < upto AND place >= upto - c").select(*keys, "bin", (F.col("place") - F.col("upto") + F.col("c")).alias("inside"))
    within = F.sum("c").over(Window.partitionBy(*keys).orderBy("x"))
    return counts.join(chosen, [*keys, "bin"]).select(*keys, "x", "inside", within.alias("upto")).where("upto > inside").groupBy(*keys).agg(F.min("x").alias("median_abs"))


def comparison_lines(metrics: DataFrame) -> DataFrame:
    """method, line: a row of the comparison table for each method."""
    line = F.format_string("%-24s %s%% %s%% %ss %ss %6d %6d", F.col("method"), T.fixed(F.col("pct_within_05"), 1, 9), T.fixed(F.col("pct_within_10"), 1, 9), T.fixed(F.col("median_abs"), 2, 7), T.fixed(F.col("max_abs"), 2, 7), F.col("early"), F.col("late"))
    return metrics.select("method", line.alias("line"))


def comparison_text(metrics: DataFrame, order: str) -> DataFrame:
    """table: the whole comparison as one text, the methods in the order of the column ``order``. Methods are few."""
    lines = metrics.join(comparison_lines(metrics), "method").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "line"))).alias("ls"))
    head = F.lit("\n".join([COMPARISON, "=" * len(COMPARISON_HEAD), COMPARISON_HEAD, "-" * len(COMPARISON_HEAD)]))
    return lines.select(F.array_join(F.concat(F.array(head), F.transform("ls", lambda x: x["line"]), F.array(F.lit(""), F.lit(COMPARISON_GOAL))), "\n").alias("table"))


def equal_split(segments: DataFrame, key: str = "rec_id") -> DataFrame:
    """key, seg_ix, start: the duration dealt by letters (one at least). segments: key, seg_ix, letters, duration."""
    weight = F.greatest(F.lit(1), F.col("letters"))
    w = Window.partitionBy(key)
    before = F.sum(weight).over(w.orderBy("seg_ix").rowsBetween(Window.unboundedPreceding, 0)) - weight
    return segments.select(key, "seg_ix", (F.col("duration") * before / F.sum(weight).over(w)).alias("start"))


def accent_frequencies(words: DataFrame, word: str = "word") -> DataFrame:
    """cp, n, words_with_several: occurrences of each accent, and words in which it stands more than once."""
    found = F.regexp_extract_all(F.col(word), F.lit(f"([{T.ACCENTS}])"), 1)
    # counted within the word first, which needs no shuffle
    in_word = words.select(found.alias("_f")).select(F.explode(F.array_distinct("_f")).alias("cp"), "_f").select("cp", F.size(F.filter("_f", lambda c: c == F.col("cp"))).alias("k"))
    return in_word.groupBy("cp").agg(F.sum("k").alias("n"), F.count_if(F.col("k") > 1).alias("words_with_several"))
