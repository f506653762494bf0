"""Alignment windows between anchors, their repair, and the spans of words and segments."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melisma.functions import text as T

MIN_SECONDS, PAD, STEP, TAIL, CUE = 8.0, 0.5, 0.02, 0.25, 0.3
#: Guards of an alignment: samples of a frame, frames a token and in all, and the longest plausible word in seconds.
FRAME, FRAMES_A_TOKEN, SPARE_FRAMES, LONGEST_WORD = 320, Decimal("1.1"), 4, 12.0


def base_windows(anchors: DataFrame, sizes: DataFrame, key: str = "rec_id", pad: float = PAD) -> DataFrame:
    """key, win_ix, word_lo, word_hi, t_lo, t_hi, sim_left, sim_right: one window between neighbouring anchors, one
    before the first unless it is the first word, one after the last unless it is the last word.

    sizes: key, n_words, duration. An anchor word belongs to both its windows; times are padded and stay in the file."""
    w = Window.partitionBy(key).orderBy("ref")
    sizes = sizes.where("n_words > 0")
    a = anchors.join(sizes, key).withColumn("next", F.struct(F.lead("ref").over(w).alias("ref"), F.lead("start").over(w).alias("start"), F.lead("end").over(w).alias("end"), F.lead("sim").over(w).alias("sim"))).withColumn("first", F.row_number().over(w) == 1)
    none = F.lit(None).cast("double")
    inner = a.where("next.ref IS NOT NULL").select(key, "duration", F.col("ref").alias("word_lo"), F.col("next.ref").alias("word_hi"), F.col("start").alias("t_lo"), F.col("next.end").alias("t_hi"), F.col("sim").alias("sim_left"), F.col("next.sim").alias("sim_right"))
    head = a.where("first AND ref > 0").select(key, "duration", F.lit(0).alias("word_lo"), F.col("ref").alias("word_hi"), F.lit(0.0).alias("t_lo"), F.col("end").alias("t_hi"), none.alias("sim_left"), F.col("sim").alias("sim_right"))
    # the only anchor may be the whole text: then its own window is all there is
    tail = a.where("next.ref IS NULL AND (ref < n_words - 1 OR (first AND ref = 0))").select(key, "duration", F.col("ref").alias("word_lo"), (F.col("n_words") - 1).alias("word_hi"), F.col("start").alias("t_lo"), F.col("duration").alias("t_hi"), F.col("sim").alias("sim_left"), none.alias("sim_right"))
    whole = sizes.join(anchors.select(key).distinct(), key, "left_anti").select(key, "duration", F.lit(0).alias("word_lo"), (F.col("n_words") - 1).alias("word_hi"), F.lit(0.0).alias("t_lo"), F.col("duration").alias("t_hi"), none.alias("sim_left"), none.alias("sim_right"))
    every = inner.unionByName(head).unionByName(tail).unionByName(whole)
    every = every.withColumn("t_lo", F.greatest(F.lit(0.0), F.col("t_lo") - pad)).withColumn("t_hi", F.least(F.col("duration"), F.col("t_hi") + pad))
    order = Window.partitionBy(key).orderBy("word_lo", "word_hi")
    return every.select(key, (F.row_number().over(order) - 1).alias("win_ix"), "word_lo", "word_hi", "t_lo", "t_hi", "sim_left", "sim_right")


def merge_short(windows: DataFrame, key: str = "rec_id", least: float = MIN_SECONDS) -> DataFrame:
    """Windows joined from the left until each lasts ``least`` seconds; a short rest joins the window before it.

    The chain of one recording is folded as an ordered array, natively."""
    fields = ["word_lo", "word_hi", "t_lo", "t_hi", "sim_left", "sim_right"]
    kind = "struct<word_lo:int,word_hi:int,t_lo:double,t_hi:double,sim_left:double,sim_right:double>"
    one = F.struct(*[F.col(f) for f in fields]).cast(kind)
    chain = windows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("win_ix"), one.alias("w")))), lambda x: x["w"]).alias("chain"))

    def joined(a: Column, b: Column) -> Column:
        return F.struct(a["word_lo"].alias("word_lo"), b["word_hi"].alias("word_hi"), a["t_lo"].alias("t_lo"), b["t_hi"].alias("t_hi"), a["sim_left"].alias("sim_left"), b["sim_right"].alias("sim_right"))

    def step(acc: Column, w: Column) -> Column:
        last = F.element_at(acc, -1)
        short = (F.size(acc) > 0) & (last["t_hi"] - last["t_lo"] < least)
        return F.when(short, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined(last, w)))).otherwise(F.concat(acc, F.array(w)))

    empty = F.expr(f"CAST(array() AS array<{kind}>)")
    folded = chain.select(key, F.when(F.size("chain") > 0, F.aggregate(F.slice("chain", 2, F.greatest(F.size("chain") - 1, F.lit(0))), F.slice("chain", 1, 1), step)).otherwise(empty).alias("c"))
    end = F.element_at("c", -1)
    rest = (F.size("c") > 1) & (end["t_hi"] - end["t_lo"] < least)
    folded = folded.select(key, F.when(rest, F.concat(F.slice("c", 1, F.size("c") - 2), F.array(joined(F.element_at("c", -2), end)))).otherwise(F.col("c")).alias("c"))
    return folded.select(key, F.posexplode("c").alias("win_ix", "w")).select(key, "win_ix", "w.*")


def build_windows(anchors: DataFrame, sizes: DataFrame, key: str = "rec_id", least: float = MIN_SECONDS, pad: float = PAD) -> DataFrame:
    return merge_short(base_windows(anchors, sizes, key, pad), key, least)


def interpolate_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, word_ix, start, end, score 0: the window's time dealt by word lengths (one at least).

    words: keys, t_lo, t_hi, word_ix, word. A window that ends before it starts has no length."""
    size = F.greatest(F.lit(1), F.length("word"))
    whole = Window.partitionBy(*keys)
    upto = F.sum(size).over(whole.orderBy("word_ix").rowsBetween(Window.unboundedPreceding, 0))
    total, span = F.sum(size).over(whole), F.greatest(F.lit(0.0), F.col("t_hi") - F.col("t_lo"))
    return words.select(*keys, "word_ix", (F.col("t_lo") + span * (upto - size) / total).alias("start"), (F.col("t_lo") + span * upto / total).alias("end"), F.lit(0.0).alias("score"))


def weaker_side(left: Column, right: Column) -> Column:
    """The side whose anchor is less similar; none counts as -1, and of equals the left is weaker."""
    return F.when(F.coalesce(left, F.lit(-1.0)) <= F.coalesce(right, F.lit(-1.0)), "left").otherwise("right")


def guard_ok(samples: Column, tokens: Column, longest: Column) -> Column:
    """Whether an aligned window is plausible: frames enough for its tokens, and no word of over 12 seconds.

    The frames that are needed are reckoned in decimals: 25 tokens need 31.5, which is less than 25 * 1.1 + 4 in binary."""
    needed = (tokens * F.lit(FRAMES_A_TOKEN) + SPARE_FRAMES).cast("double")
    return (samples / FRAME >= needed) & (F.coalesce(longest, F.lit(0.0)) <= LONGEST_WORD)


Spans = list[tuple[float, float, float]]


def repair_windows(windows: list[dict], align: Callable[[dict], Spans | None], words: list[str]) -> list[tuple[dict, Spans, bool]]:
    """Aligned windows (window, spans, interpolated) of one recording.

    A window that fails is aligned together with a neighbour, the one across its weaker anchor first: on the left with
    what was put out last, if that is aligned and ends with the shared word; on the right with the next window, if that
    could be aligned alone. Where both fail its words are interpolated."""
    done: list[tuple[dict, Spans, bool]] = []
    alone = [align(w) for w in windows]
    i = 0
    while i < len(windows):
        w, spans, taken = windows[i], alone[i], 1
        if spans is None:
            sim = [-1.0 if w[s] is None or w[s] != w[s] else w[s] for s in ("sim_left", "sim_right")]
            for side in ("left", "right") if sim[0] <= sim[1] else ("right", "left"):
                if side == "left" and done and not done[-1][2] and done[-1][0]["word_hi"] == w["word_lo"]:
                    pair = done[-1][0] | {k: w[k] for k in ("word_hi", "t_hi", "sim_right")}
                elif side == "right" and i + 1 < len(windows) and alone[i + 1] is not None:
                    pair = w | {k: windows[i + 1][k] for k in ("word_hi", "t_hi", "sim_right")}
                else:
                    continue
                spans = align(pair)
                if spans is not None:
                    w = pair
                    if side == "left":
                        done.pop()
                    else:
                        taken = 2
                    break
        if spans is None:
            part = words[w["word_lo"] : w["word_hi"] + 1]
            sizes = [max(1, len(x)) for x in part]
            span, total, upto, spans = max(0.0, w["t_hi"] - w["t_lo"]), sum(sizes), 0, []
            for n in sizes:
                spans.append((w["t_lo"] + span * upto / total, w["t_lo"] + span * (upto + n) / total, 0.0))
                upto += n
            done.append((w, spans, True))
        else:
            done.append((w, spans, False))
        i += taken
    return done


def align_windows(windows: DataFrame, words: DataFrame, align: Callable[[dict, list[str]], Spans | None], key: str = "rec_id") -> DataFrame:
    """key, win_ix, word_ix, start, end, score, interpolated. ``align`` gets a window and its words and returns a span
    for each, or None if it fails; it runs on the executors, recordings in parallel."""
    kind = dict(windows.dtypes)[key]
    names = ["win_ix", "word_lo", "word_hi", "t_lo", "t_hi", "sim_left", "sim_right"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        text = right.sort_values("word_ix")["word"].tolist()
        chain = [{k: (None if v != v else v) for k, v in r.items()} for r in left.sort_values("win_ix")[names].to_dict("records")]
        chain = [{k: int(v) if k in ("win_ix", "word_lo", "word_hi") else v for k, v in r.items()} for r in chain]
        rows = []
        for i, (w, spans, filled) in enumerate(repair_windows(chain, lambda x: align(x, text[x["word_lo"] : x["word_hi"] + 1]), text)):
            rows += [(left[key].iloc[0], i, w["word_lo"] + j, float(a), float(b), float(s), filled) for j, (a, b, s) in enumerate(spans)]
        return pd.DataFrame(rows, columns=[key, "win_ix", "word_ix", "start", "end", "score", "interpolated"])

    return windows.groupBy(key).cogroup(words.groupBy(key)).applyInPandas(run, f"{key} {kind}, win_ix int, word_ix int, start double, end double, score double, interpolated boolean")


def monotone(x: Column, i: Column, window, step: float) -> Column:
    """x[i] = max(x[i], x[i-1] + step) along an ordered window, in closed form; i counts from the window's start."""
    return F.max(x - i * step).over(window.rowsBetween(Window.unboundedPreceding, 0)) + i * step


def stitch(aligned: DataFrame, sizes: DataFrame, key: str = "rec_id", step: float = STEP) -> DataFrame:
    """One span for each word (a shared word keeps that of its left window), starts in order by ``step``, ends not before
    starts. Fails if a recording's words are not all there. sizes: key, n_words."""
    first = Window.partitionBy(key, "word_ix").orderBy("win_ix")
    one = aligned.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    count = one.groupBy(key).agg(F.count("*").alias("_n"), F.min("word_ix").alias("_a"), F.max("word_ix").alias("_z"))
    ok = sizes.join(count, key, "left").select(key, F.when((F.coalesce("_n", F.lit(0)) == F.col("n_words")) & (F.coalesce("_a", F.lit(0)) == 0) & (F.coalesce("_z", F.col("n_words") - 1) == F.col("n_words") - 1), True).otherwise(F.raise_error(F.lit("windows do not cover the words"))).alias("_ok"))
    start = monotone(F.col("start"), F.col("word_ix"), Window.partitionBy(key).orderBy("word_ix"), step)
    return one.join(ok, key).where("_ok").withColumn("start", start).withColumn("end", F.greatest("end", "start")).select(key, "word_ix", "start", "end", "score", "interpolated")


def clamp_back(times: Column, i: Column, n: Column, end: Column, gap: float = 0.05) -> Column:
    """Entries but the first leave room for those after them before the end."""
    return F.when(i >= 1, F.least(times, end - (n - i) * gap)).otherwise(times)


def segment_bounds(segments: DataFrame, spans: DataFrame, key: str = "rec_id") -> DataFrame:
    """key, seg_ix, start, end: start of a segment's first word and end of its last. segments: key, seg_ix, n_words.

    The range join is an equi-join on word positions: the ranges are exploded to their words first."""
    upto = F.sum("n_words").over(Window.partitionBy(key).orderBy("seg_ix").rowsBetween(Window.unboundedPreceding, 0))
    ranges = segments.where("n_words > 0").select(key, "seg_ix", (upto - F.col("n_words")).cast("int").alias("_lo"), (upto - 1).cast("int").alias("_hi"))
    places = ranges.select(key, "seg_ix", F.explode(F.sequence("_lo", "_hi")).alias("word_ix"))
    return places.join(spans, [key, "word_ix"]).groupBy(key, "seg_ix").agg(F.min_by("start", "word_ix").alias("start"), F.max_by("end", "word_ix").alias("end"))


def srt_cues(bounds: DataFrame, key: str = "rec_id", tail: float = TAIL) -> DataFrame:
    """key, n, start, end, text of subtitle cues: a cue ends where the next begins, the last a little after its speech;
    none is shorter than 0.3 seconds. bounds: key, seg_ix, start, end, display."""
    w = Window.partitionBy(key).orderBy("seg_ix")
    end = F.coalesce(F.lead("start").over(w), F.col("end") + tail)
    return bounds.select(key, F.row_number().over(w).alias("n"), "start", F.greatest(end, F.col("start") + CUE).alias("end"), F.col("display").alias("text"))


def srt_body(cues: DataFrame, key: str = "rec_id") -> DataFrame:
    """key, body: the subtitle file of each recording."""
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), T.srt_time(F.col("start")), F.lit(" --> "), T.srt_time(F.col("end")), F.lit("\n"), F.col("text"), F.lit("\n"))
    return cues.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))).alias("_b")).select(key, F.array_join(F.transform("_b", lambda x: x["b"]), "\n").alias("body"))


def interpolate_free(bounds: DataFrame, key: str = "rec_id") -> DataFrame:
    """Boundaries without time filled between their nearest timed neighbours by cumulated weight (by place where the
    weight does not grow). bounds: key, i, time (null: free), cum."""
    w = Window.partitionBy(key).orderBy("i")
    fixed = F.when(F.col("time").isNotNull(), F.struct("i", "time", "cum"))
    back = F.last(fixed, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(fixed, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    x = bounds.withColumn("_a", back).withColumn("_b", ahead)
    by_weight = (F.col("cum") - F.col("_a.cum")) / (F.col("_b.cum") - F.col("_a.cum"))
    by_place = (F.col("i") - F.col("_a.i")) / (F.col("_b.i") - F.col("_a.i"))
    share = F.when(F.col("_b.cum") > F.col("_a.cum"), by_weight).otherwise(by_place)
    return x.select(key, "i", F.coalesce("time", F.col("_a.time") + share * (F.col("_b.time") - F.col("_a.time"))).alias("time"))
