"""Signals: energy frames, speech and pauses, nearest onsets, and boundaries matched to pauses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melisma.config import TimingOptions
from melisma.operators.windows import monotone

RADIUS, VERSE_RADIUS, STEP = 0.35, 0.7, 0.02


def js_round(x: Column) -> Column:
    """Half up."""
    return F.floor(x + 0.5)


def frame_db(signal: Column, hop: int, win: int) -> Column:
    """Level in dB (as floats) of the full windows of a signal, ``hop`` samples apart: root mean square over ``win``
    samples of one channel."""
    n = F.size(signal)
    frames = F.greatest(F.lit(0), F.floor((n - win) / hop).cast("int") + 1)
    starts = F.when(frames > 0, F.sequence(F.lit(0), frames - 1)).otherwise(F.array().cast("array<int>"))

    def level(f: Column) -> Column:
        part = F.slice(signal, f * hop + 1, F.lit(win))
        power = F.aggregate(part, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
        return (20 * F.log10(F.sqrt(power / win) + 1e-8)).cast("float")

    return F.transform(starts, level)


def frame_db_rows(samples: DataFrame, hop: int, win: int, key: str = "rec_id") -> DataFrame:
    """key, frame, db from samples (key, channel, i, x) of long recordings: squares are summed over the channels, then
    over the frames each sample belongs to (win / hop of them), so a recording of any length stays distributed."""
    many = -(-win // hop)
    channels = samples.groupBy(key).agg(F.count_distinct("channel").alias("channels"), (F.max("i") + 1).alias("n"))
    power = samples.groupBy(key, "i").agg(F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("p"))
    last = F.floor(F.col("i") / hop)
    first = F.greatest(F.lit(0), last - many + 1)
    spread = power.select(key, "i", "p", F.explode(F.sequence(first, last)).alias("frame")).where((F.col("i") >= F.col("frame") * hop) & (F.col("i") < F.col("frame") * hop + win))
    summed = spread.groupBy(key, "frame").agg(F.sum("p").alias("p")).join(channels, key).where(F.col("frame") * hop + win <= F.col("n"))
    return summed.select(key, F.col("frame").cast("int").alias("frame"), (20 * F.log10(F.sqrt(F.col("p") / (win * F.col("channels"))) + 1e-8)).cast("float").alias("db"))


def quantile_at(values: Column, p: float) -> Column:
    """The sorted value at the rounded (half up) place p (n - 1)."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.least(F.size(ordered) - 1, js_round(p * (F.size(ordered) - 1))).cast("int"))


def speech_threshold(levels: Column) -> Column:
    """Three tenths of the way from the quiet to the loud level, and six dB above the quiet one at least."""
    quiet, loud = quantile_at(levels, 0.05).cast("double"), quantile_at(levels, 0.9).cast("double")
    return F.greatest(quiet + 6, quiet + 0.3 * (loud - quiet))


def speech_mask(frames: DataFrame, min_frames: int, key: str = "rec_id") -> DataFrame:
    """key, frame, is_speech: above the recording's threshold, runs shorter than ``min_frames`` erased."""
    level = frames.groupBy(key).agg(speech_threshold(F.collect_list("db")).alias("_th"))
    loud = frames.join(level, key).withColumn("_s", F.col("db").cast("double") > F.col("_th"))
    size = F.count("*").over(Window.partitionBy(key, "run"))
    return with_runs(loud, "_s", [key], "frame").select(key, "frame", (F.col("_s") & (size >= min_frames)).alias("is_speech"))


def with_runs(rows: DataFrame, flag: str, keys: list[str], order: str) -> DataFrame:
    """The rows with ``run``: numbers of runs of equal flags (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = rows.withColumn("_c", (~F.col(flag).eqNullSafe(F.lag(flag).over(w))).cast("int"))
    return changed.withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def find_pauses(mask: DataFrame, hop: float, min_pause: float, key: str = "rec_id") -> tuple[DataFrame, DataFrame]:
    """(key, start, end, dur) of silences of ``min_pause`` seconds or more between the first and last speech, and (key,
    speech_start, speech_end); both times are 0 without speech."""
    ends = mask.groupBy(key).agg(F.min(F.when(F.col("is_speech"), F.col("frame"))).alias("_a"), F.max(F.when(F.col("is_speech"), F.col("frame"))).alias("_z"))
    bounds = ends.select(key, F.coalesce(F.col("_a") * hop, F.lit(0.0)).alias("speech_start"), F.coalesce((F.col("_z") + 1) * hop, F.lit(0.0)).alias("speech_end"))
    inside = mask.join(ends, key).where((F.col("frame") >= F.col("_a")) & (F.col("frame") <= F.col("_z"))).select(key, "frame", "is_speech")
    runs = with_runs(inside, "is_speech", [key], "frame").where("NOT is_speech").groupBy(key, "run").agg(F.min("frame").alias("a"), F.max("frame").alias("z"))
    dur = (F.col("z") + 1 - F.col("a")) * hop
    return runs.where(dur >= min_pause).select(key, (F.col("a") * hop).alias("start"), ((F.col("z") + 1) * hop).alias("end"), dur.alias("dur")), bounds


def snap_boundaries(starts: DataFrame, onsets: DataFrame, key: str = "rec_id", radius: float = RADIUS, verse_radius: float = VERSE_RADIUS, step: float = STEP) -> DataFrame:
    """key, seg_ix, start, snap: every start moved to the nearest onset within its radius (the earlier of equals), then
    starts in order by ``step``. snap is the distance moved, null if it did not snap or had to give way.

    starts: key, seg_ix, start, opens_verse; onsets: key, t. A nearest as-of join: starts and onsets are ordered
    together, and the last onset before and the first after are carried to each start."""
    s = starts.select(key, F.col("start").alias("t"), F.lit(1).alias("kind"), "seg_ix", "opens_verse")
    o = onsets.select(key, "t", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("seg_ix"), F.lit(None).cast("boolean").alias("opens_verse"))
    onset = F.when(F.col("kind") == 0, F.col("t"))
    w = Window.partitionBy(key).orderBy("t", "kind")
    both = s.unionByName(o).withColumn("_b", F.last(onset, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_a", F.first(onset, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    both = both.where("kind = 1")
    reach = F.when(F.coalesce("opens_verse", F.lit(False)), verse_radius).otherwise(radius)
    nearer = F.when(F.col("_a").isNull() | (F.col("t") - F.col("_b") <= F.col("_a") - F.col("t")), F.col("_b")).otherwise(F.col("_a"))
    picked = both.withColumn("_o", F.coalesce(nearer, F.col("_a"))).withColumn("_d", F.abs(F.col("_o") - F.col("t")))
    hit = F.coalesce(F.col("_d") <= reach, F.lit(False))
    moved = picked.withColumn("_x", F.when(hit, F.col("_o")).otherwise(F.col("t"))).withColumn("_snap", F.when(hit, F.col("_d")))
    order = Window.partitionBy(key).orderBy("seg_ix")
    moved = moved.withColumn("_i", F.row_number().over(order)).withColumn("start", monotone(F.col("_x"), F.col("_i"), order, step))
    return moved.select(key, "seg_ix", F.when(F.col("start") > F.col("_x") + 1e-9, F.col("start")).otherwise(F.col("_x")).alias("start"), F.when(F.col("start") <= F.col("_x") + 1e-9, F.col("_snap")).alias("snap"))


def match_pauses(expected: list[float], pauses: list[tuple[float, float]], skip: float, bonus: float) -> list[int]:
    """For each boundary the pause (time, seconds) it is matched to, or -1, at the least total cost.

    A pause may stay unused for nothing, a boundary for ``skip``; a match costs its distance less the bonus for long
    pauses. Among equals an unused pause goes before a match, and a match before an unmatched boundary."""
    n, p = len(expected), len(pauses)
    best = [[0.0] * (p + 1)]
    for k, e in enumerate(expected):
        row = [best[-1][0] + skip]
        for j, (t, dur) in enumerate(pauses):
            row.append(min(row[-1], best[-1][j] + max(0.0, abs(e - t) - bonus * min(dur, 1.5)), best[-1][j + 1] + skip))
        best.append(row)
    out, k, j = [-1] * n, n, p
    while k and j:
        t, dur = pauses[j - 1]
        if best[k][j] == best[k][j - 1]:
            j -= 1
        elif best[k][j] == best[k - 1][j - 1] + max(0.0, abs(expected[k - 1] - t) - bonus * min(dur, 1.5)):
            out[k - 1] = j - 1
            k, j = k - 1, j - 1
        else:
            k -= 1
    return out


def time_segments(letters: list[int | None], verse_end: list[bool], pauses: list[tuple[float, float]], speech: tuple[float, float], duration: float, o: TimingOptions = TimingOptions()) -> tuple[list[float], float, int, int, int]:
    """Start times, end time, verse boundaries, matched ones and snapped inner boundaries of one recording.

    pauses: (start, end). Verse boundaries are matched to pauses first; between what is fixed, inner boundaries are
    matched to the pauses left over, again after each round that fixed some; free boundaries follow the text weights."""
    n = len(letters)
    a, z = speech if speech[1] > speech[0] else (0.0, duration)
    cum = [0.0]
    for count, end in zip(letters, verse_end, strict=True):
        cum.append(cum[-1] + (count or 1) + 2 + (5 if end else 0))
    onsets = [(max(s, e - o.pad), e - s) for s, e in pauses]
    fixed: dict[int, float] = {0: max(0.0, a - o.pad), n: z}
    used: set[int] = set()
    verses = [i for i in range(1, n) if verse_end[i - 1]]
    hits = [(i, j) for i, j in zip(verses, match_pauses([a + (z - a) * cum[i] / cum[n] for i in verses], onsets, o.skip, o.bonus), strict=True) if j >= 0]
    for i, j in hits:
        fixed[i] = onsets[j][0]
        used.add(j)

    def filled() -> list[float]:
        marks, out = sorted(fixed), [0.0] * (n + 1)
        for p, q in zip(marks[:-1], marks[1:], strict=True):
            for i in range(p, q + 1):
                share = (cum[i] - cum[p]) / (cum[q] - cum[p]) if cum[q] > cum[p] else (i - p) / (q - p)
                out[i] = fixed[p] + share * (fixed[q] - fixed[p])
        for i in marks:
            out[i] = fixed[i]
        return out

    times, snapped = filled(), 0
    for _ in range(o.rounds):
        found: list[tuple[int, int]] = []
        marks = sorted(fixed)
        for p, q in zip(marks[:-1], marks[1:], strict=True):
            free = [j for j, (t, _) in enumerate(onsets) if j not in used and fixed[p] + o.min_gap < t < fixed[q] - o.min_gap]
            inner = range(p + 1, q)
            if free and inner:
                got = match_pauses([times[i] for i in inner], [onsets[j] for j in free], o.snap, 0.0)
                new = [(i, free[j]) for i, j in zip(inner, got, strict=True) if j >= 0]
                used |= {j for _, j in new}
                found += new
        if not found:
            break
        fixed |= {i: onsets[j][0] for i, j in found}
        snapped += len(found)
        times = filled()
    times, end = times[:n], min(duration, z + 0.15)
    for i in range(1, n):
        times[i] = max(times[i], times[i - 1] + o.min_gap)
    end = max(end, times[-1] + 0.3)
    times = [times[0], *(min(t, end - (n - i) * o.min_gap) for i, t in enumerate(times[1:], 1))]
    return times, end, len(verses), len(hits), snapped


def analyze(segments: DataFrame, pauses: DataFrame, bounds: DataFrame, key: str = "rec_id", o: TimingOptions = TimingOptions()) -> DataFrame:
    """key, seg_ix, start, end_time and the diagnostics of every segment of every recording.

    segments: key, seg_ix, letters, verse_end; pauses: key, start, end; bounds: key, speech_start, speech_end, duration.
    One row of arrays for each recording meets Python, recordings in parallel."""
    s = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seg_ix", "letters", "verse_end"))).alias("s"))
    p = pauses.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("p"))
    rows = s.join(bounds, key).join(p, key, "left")

    def timed(x: pd.DataFrame) -> pd.Series:
        out = []
        for r in x.to_dict("records"):
            found = [(q["start"], q["end"]) for q in r["p"]] if r["p"] is not None else []
            t, end, total, hits, snapped = time_segments([q["letters"] for q in r["s"]], [q["verse_end"] for q in r["s"]], found, (r["a"], r["z"]), r["d"], o)
            out.append({"times": t, "end_time": end, "pauses": len(found), "anchors": total, "matched": hits, "snapped": snapped})
        return pd.DataFrame(out)

    udf = F.pandas_udf(timed, "times array<double>, end_time double, pauses int, anchors int, matched int, snapped int")
    x = F.struct(F.col("s"), F.col("p"), F.col("speech_start").alias("a"), F.col("speech_end").alias("z"), F.col("duration").alias("d"))
    got = rows.withColumn("_t", udf(x))
    return got.select(key, "duration", "speech_start", "speech_end", F.col("_t.end_time").alias("end_time"), F.col("_t.pauses").alias("pauses_found"), F.col("_t.anchors").alias("anchors_total"), F.col("_t.matched").alias("anchors_matched"), F.col("_t.snapped").alias("inner_snapped"), F.posexplode("_t.times").alias("seg_ix", "start"))
