"""Queries of alignment, windows, signals and quality over the stand-in recordings, with their SQL twins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from melisma.functions import text as T
from melisma.operators import align, quality, signal, windows
from melisma.plans.registry import query
from melisma.plans.standins import FROM, TO, hebrew, read, recordings, with_
from melisma.sources import files


def r6(c, name):
    return F.round(c, 6).alias(name)


# Pairs of an alignment by rule: some events have no heard or no known word; the similarity follows the event.
_PAIR = "SELECT rec_id, k, t, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(count_if(event_id % 11 <> 0) OVER w - 1 AS INT) END AS asr_i, CASE WHEN event_id % 13 = 1 AND event_id % 11 <> 0 THEN NULL ELSE CAST(count_if(event_id % 13 <> 1 OR event_id % 11 = 0) OVER w - 1 AS INT) END AS ref_j, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 1 THEN 0.0 ELSE (event_id * 37 % 101) / 100.0 END AS sim, event_type || CAST(event_id % 40 AS VARCHAR) AS word FROM rec WINDOW w AS (PARTITION BY rec_id ORDER BY k ROWS UNBOUNDED PRECEDING)"
_KNOWN = "SELECT rec_id, ref_j AS ix, word FROM pair WHERE ref_j IS NOT NULL"
_MARKED = "SELECT *, coalesce(ix - lag(ix) OVER w <= 10, false) OR coalesce(lead(ix) OVER w - ix <= 10, false) AS repeated FROM known WINDOW w AS (PARTITION BY rec_id, word ORDER BY ix)"
_CONTEXT = "SELECT *, coalesce(lag(good) OVER w, false) OR coalesce(lead(good) OVER w, false) AS context FROM (SELECT *, asr_i IS NOT NULL AND ref_j IS NOT NULL AND sim >= 0.6 AS good FROM pair) WINDOW w AS (PARTITION BY rec_id ORDER BY k)"


def _pairs(spark, d):
    e = F.col("event_id")
    heard, known = e % 11 != 0, (e % 13 != 1) | (e % 11 == 0)
    w = Window.partitionBy("rec_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    r = recordings(spark, d)
    return r.select("rec_id", "k", "t", F.when(heard, F.count_if(heard).over(w) - 1).cast("int").alias("asr_i"), F.when(known, F.count_if(known).over(w) - 1).cast("int").alias("ref_j"), F.when((e % 11 == 0) | (e % 13 == 1), 0.0).otherwise((e * 37 % 101) / 100.0).alias("sim"), F.concat("event_type", (e % 40).cast("string")).alias("word"))


def _known(p):
    return p.where("ref_j IS NOT NULL").select("rec_id", F.col("ref_j").alias("ix"), "word")


@query("repeated_nearby", with_("rec", "SELECT rec_id, ix, word, repeated FROM marked", {"pair": _PAIR, "known": _KNOWN, "marked": _MARKED}))
def repeated_nearby(spark, d):
    return align.repeated_nearby(_known(_pairs(spark, d)))


@query("coverage", with_("rec", "SELECT rec_id, round(count_if(asr_i IS NOT NULL AND ref_j IS NOT NULL AND sim >= 0.7) / count(ref_j), 6) AS coverage FROM pair GROUP BY rec_id HAVING count(ref_j) > 0", {"pair": _PAIR}))
def coverage(spark, d):
    p = _pairs(spark, d)
    return align.coverage(p, _known(p)).select("rec_id", r6(F.col("coverage"), "coverage"))


@query("has_context", with_("rec", "SELECT rec_id, k, context FROM ctx", {"pair": _PAIR, "ctx": _CONTEXT}))
def has_context(spark, d):
    return align.with_context(_pairs(spark, d)).select("rec_id", "k", "context")


_CAND = "SELECT c.rec_id, c.ref_j AS ref, c.asr_i AS asr, c.t AS start, c.t + 0.4 AS end_, c.sim FROM ctx c JOIN marked m ON c.rec_id = m.rec_id AND c.ref_j = m.ix WHERE c.asr_i IS NOT NULL AND c.sim >= 0.85 AND c.context AND NOT m.repeated AND len(m.word) >= 3"


@query("anchor_candidates", with_("rec", "SELECT rec_id, ref, asr, round(start, 6) AS start, round(end_, 6) AS finish, sim FROM cand", {"pair": _PAIR, "known": _KNOWN, "marked": _MARKED, "ctx": _CONTEXT, "cand": _CAND}))
def anchor_candidates(spark, d):
    p = _pairs(spark, d)
    times = p.where("asr_i IS NOT NULL").select("rec_id", F.col("asr_i").alias("ix"), F.col("t").alias("start"), (F.col("t") + 0.4).alias("end"))
    return align.candidates(p, _known(p), times).select("rec_id", "ref", "asr", r6(F.col("start"), "start"), r6(F.col("end"), "finish"), "sim")


def _streams(spark, d):
    """Heard and known words of each turn of a conversation: heard ones leave out, double and change words by rule."""
    c = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("rec_id"), F.posexplode(F.split(F.lower("text"), r"\s+")).alias("i", "w")).where(F.col("w").rlike("[a-z]"))
    known = c.select("rec_id", F.col("i").alias("ix"), hebrew(F.col("w")).alias("word"))
    times = F.when(F.col("ix") % 7 == 3, F.array().cast("array<int>")).when(F.col("ix") % 11 == 5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    heard = known.select("rec_id", "ix", F.explode(times).alias("j"), F.when(F.col("ix") % 5 == 1, F.concat("word", F.lit("ו"))).otherwise(F.col("word")).alias("word"))
    return heard.select("rec_id", (2 * F.col("ix") + F.col("j")).alias("ix"), "word", (F.col("ix") * 0.5).alias("start"), (F.col("ix") * 0.5 + 0.4).alias("end")), known


# The known words of the streams, normalised, and the table of the distance, a row of it in each step.
_SPOKEN = f"""SELECT rec_id, ix, CASE WHEN w = '{T.HEARD_AS}' THEN '{T.READ_AS}' ELSE w END AS word FROM (SELECT conv_id * 1000 + turn AS rec_id, ix, translate(regexp_replace(translate(w, '{FROM}', '{TO}'), '[^א-ת]', '', 'g'), '{T.FINALS}', '{T.ORDINARY}') AS w FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w, generate_subscripts(regexp_split_to_array(lower(text), '\\s+'), 1) AS ix FROM conversations) WHERE regexp_matches(w, '[a-z]'))"""
_CHEAP = "CASE WHEN {0} IN ('ו', 'י') THEN 0.25 ELSE 1.0 END :: DOUBLE"
_TABLE = f"""SELECT a, b, 0 AS i, cum AS r, cum FROM (SELECT a, b, list_transform(range(0, len(b) + 1), lambda j: coalesce(list_sum(list_transform(string_split(b[1:j], ''), lambda c: CASE WHEN c = '' THEN 0.0 ELSE {_CHEAP.format('c')} END)), 0.0) :: DOUBLE) AS cum FROM two)
UNION ALL SELECT a, b, i + 1, list_transform(range(1, len(b) + 2), lambda j: cum[j] + list_min(list_transform(range(1, j + 1), lambda k: (CASE WHEN k = 1 THEN r[1] + {_CHEAP.format('a[i + 1]')} ELSE least(r[k - 1] + CASE WHEN a[i + 1] = b[k - 1] THEN 0.0 ELSE 1.0 END :: DOUBLE, r[k] + {_CHEAP.format('a[i + 1]')}) END) - cum[k]))), cum FROM dp WHERE i < len(a)"""
_TWO = "SELECT DISTINCT word AS a, reverse(word) AS b FROM spoken WHERE word <> ''"
_NEXT = "SELECT DISTINCT a, b FROM (SELECT word AS a, lead(word) OVER (PARTITION BY rec_id ORDER BY ix) AS b FROM spoken) WHERE b IS NOT NULL"
_DISTANCE = f"WITH RECURSIVE spoken AS ({_SPOKEN}), two AS ({{0}}), dp AS ({_TABLE}) SELECT a, b, {{1}} FROM dp WHERE i = len(a)"


@query("weighted_distance", _DISTANCE.format(_TWO, "r[len(b) + 1] AS distance"))
def weighted_distance(spark, d):
    _, known = _streams(spark, d)
    w = known.select(T.normalize_word(F.col("word")).alias("a"), F.reverse(T.normalize_word(F.col("word"))).alias("b")).where(F.length("a") > 0).distinct()
    return w.select("a", "b", align._distance(F.col("a"), F.col("b")).alias("distance"))


@query("word_similarity", _DISTANCE.format(_NEXT, "CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 WHEN abs(len(a) - len(b)) > 3 THEN 0.0 ELSE greatest(0.0, 1 - r[len(b) + 1] / greatest(len(a), len(b))) END :: DOUBLE AS similarity"))
def word_similarity(spark, d):
    _, known = _streams(spark, d)
    n = T.normalize_word(F.col("word"))
    w = Window.partitionBy("rec_id").orderBy("ix")
    pairs = known.select("rec_id", "ix", n.alias("a")).withColumn("b", F.lead("a").over(w)).where("b IS NOT NULL").select("a", "b").distinct()
    return pairs.select("a", "b", align.word_similarity(F.col("a"), F.col("b")).alias("similarity"))


def _found(spark, d):
    return align.find_anchors(*_streams(spark, d))


@query("align_sequences")
def align_sequences(spark, d):
    return _found(spark, d)["pairs"]


_RISING = """SELECT rec_id, k, [value] AS vs, [1] AS ls, [0] AS bs FROM rec WHERE k = 0
UNION ALL SELECT rec_id, k, list_append(vs, value), list_append(ls, best + 1), list_append(bs, CASE WHEN best = 0 THEN 0 ELSE list_min(list_filter(range(1, len(vs) + 1), lambda j: vs[j] < value AND ls[j] = best)) END) FROM (SELECT rec.rec_id, rec.k, vs, ls, bs, value, coalesce(list_max(list_transform(list_filter(range(1, len(vs) + 1), lambda j: vs[j] < value), lambda j: ls[j])), 0) AS best FROM rise JOIN rec ON rec.rec_id = rise.rec_id AND rec.k = rise.k + 1)"""
_BACK = """SELECT rec_id, CAST(list_position(ls, list_max(ls)) AS BIGINT) AS place, bs FROM rise WHERE (rec_id, k) IN (SELECT rec_id, max(k) FROM rec GROUP BY rec_id)
UNION ALL SELECT rec_id, bs[place], bs FROM back WHERE bs[place] > 0"""


@query("longest_increasing", with_("rec", "SELECT rec.rec_id, k, value FROM back JOIN rec ON rec.rec_id = back.rec_id AND k = place - 1", {"rise": _RISING, "back": _BACK}, True))
def longest_increasing(spark, d):
    longest = align.longest_increasing

    def run(x):
        x = x.sort_values("k")
        return x.iloc[longest(x["value"].tolist())][["rec_id", "k", "value"]]

    return recordings(spark, d).select("rec_id", "k", "value").groupBy("rec_id").applyInPandas(run, "rec_id long, k int, value double")


# While two neighbours are out of pace one of them goes, and the look goes back by one.
_PACED = """SELECT rec_id, 1 AS i, list({'ref': k, 'fin': t + 0.4, 'start': t, 'sim': (event_id * 37 % 101) / 100.0} ORDER BY k) AS xs FROM rec WHERE k % 3 = 0 GROUP BY rec_id
UNION ALL SELECT rec_id, CASE WHEN fits THEN i + 1 ELSE greatest(1, i - 1) END, CASE WHEN fits THEN xs ELSE list_concat(xs[1:i - CASE WHEN xs[i].sim <= xs[i + 1].sim THEN 1 ELSE 0 END], xs[i + CASE WHEN xs[i].sim <= xs[i + 1].sim THEN 1 ELSE 2 END:]) END FROM (SELECT *, greatest(xs[i + 1].fin - xs[i].fin, 1e-6) / greatest(xs[i + 1].ref - xs[i].ref, 1) BETWEEN 0.12 AND 4.0 AS fits FROM paced WHERE i < len(xs))"""


@query("enforce_rate", with_("rec", "SELECT rec_id, x.ref AS ref, round(x.start, 6) AS start, round(x.fin, 6) AS finish, x.sim AS sim FROM (SELECT rec_id, unnest(xs) AS x FROM paced WHERE i >= len(xs))", {"paced": _PACED}, True))
def enforce_rate(spark, d):
    a = recordings(spark, d).where("k % 3 = 0").select("rec_id", F.col("k").alias("ref"), F.col("t").alias("start"), (F.col("t") + 0.4).alias("end"), ((F.col("event_id") * 37 % 101) / 100.0).alias("sim"))
    names, enforce = ["rec_id", "ref", "start", "end", "sim"], align.enforce_rate
    run = lambda x: pd.DataFrame(enforce(x.sort_values("ref").to_dict("records")), columns=names)
    out = a.groupBy("rec_id").applyInPandas(run, "rec_id long, ref int, start double, end double, sim double")
    return out.select("rec_id", "ref", r6(F.col("start"), "start"), r6(F.col("end"), "finish"), "sim")


@query("select_anchors")
def select_anchors(spark, d):
    return _found(spark, d)["anchors"]


@query("find_anchors")
def find_anchors(spark, d):
    f = _found(spark, d)
    return f["matches"].groupBy("rec_id").agg(F.count("*").alias("matches")).join(f["coverage"], "rec_id", "full").join(f["anchors"].groupBy("rec_id").agg(F.count("*").alias("anchors")), "rec_id", "left")


@query("match_pauses")
def match_pauses(spark, d):
    r = recordings(spark, d).groupBy("rec_id").agg(F.array_sort(F.collect_list(F.when(F.col("event_type") == "click", F.col("t")))).alias("e"), F.array_sort(F.collect_list(F.when(F.col("event_type") == "view", F.struct("t", (F.col("value") / 20).alias("dur"))))).alias("p"))

    match = signal.match_pauses

    @F.pandas_udf("array<int>")
    def run(e: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([match(list(x), [(q["t"], q["dur"]) for q in y], 2.0, 0.4) for x, y in zip(e, p, strict=True)])

    return r.select("rec_id", F.posexplode(run("e", "p")).alias("boundary", "pause"))


# Windows: every tenth event is an anchor.
_ANCHOR = "SELECT rec_id, k AS ref, t AS start, t + 0.4 AS end_, (event_id * 37 % 101) / 100.0 AS sim FROM rec WHERE k % 10 = 3"
_SIZE = "SELECT rec_id, CAST(count(*) AS INT) AS n_words, max(t) + 1 AS duration FROM rec GROUP BY rec_id"
_BASE = """SELECT rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY word_lo, word_hi) - 1 AS INT) AS win_ix, word_lo, word_hi, greatest(0.0, t_lo - 0.5) AS t_lo, least(duration, t_hi + 0.5) AS t_hi, sim_left, sim_right FROM (
SELECT rec_id, duration, ref AS word_lo, nref AS word_hi, start AS t_lo, nend AS t_hi, sim AS sim_left, nsim AS sim_right FROM a WHERE nref IS NOT NULL
UNION ALL SELECT rec_id, duration, 0, ref, 0.0, end_, NULL, sim FROM a WHERE first_ AND ref > 0
UNION ALL SELECT rec_id, duration, ref, n_words - 1, start, duration, sim, NULL FROM a WHERE nref IS NULL AND (ref < n_words - 1 OR (first_ AND ref = 0))
UNION ALL SELECT rec_id, duration, 0, n_words - 1, 0.0, duration, NULL, NULL FROM size_ WHERE rec_id NOT IN (SELECT rec_id FROM anchor))"""
_WINDOWS = {"anchor": _ANCHOR, "size_": _SIZE, "a": "SELECT anchor.*, n_words, duration, lead(ref) OVER w AS nref, lead(end_) OVER w AS nend, lead(sim) OVER w AS nsim, row_number() OVER w = 1 AS first_ FROM anchor JOIN size_ USING (rec_id) WINDOW w AS (PARTITION BY rec_id ORDER BY ref)", "base": _BASE}
_MERGED = {
    "grp": "SELECT rec_id, win_ix, win_ix AS g, t_lo AS g_lo, t_hi FROM base WHERE win_ix = 0 UNION ALL SELECT b.rec_id, b.win_ix, CASE WHEN grp.t_hi - g_lo < 8.0 THEN g ELSE b.win_ix END, CASE WHEN grp.t_hi - g_lo < 8.0 THEN g_lo ELSE b.t_lo END, b.t_hi FROM grp JOIN base b ON b.rec_id = grp.rec_id AND b.win_ix = grp.win_ix + 1",
    "fold": "SELECT b.rec_id, g, min(b.word_lo) AS word_lo, max(b.word_hi) AS word_hi, arg_min(b.t_lo, b.win_ix) AS t_lo, arg_max(b.t_hi, b.win_ix) AS t_hi FROM grp JOIN base b USING (rec_id, win_ix) GROUP BY b.rec_id, g",
    "rest": "SELECT *, CASE WHEN lead(g) OVER w IS NULL AND lag(g) OVER w IS NOT NULL AND t_hi - t_lo < 8.0 THEN lag(g) OVER w ELSE g END AS h FROM fold WINDOW w AS (PARTITION BY rec_id ORDER BY g)",
}


def _anchors(spark, d):
    return recordings(spark, d).where("k % 10 = 3").select("rec_id", F.col("k").alias("ref"), F.col("t").alias("start"), (F.col("t") + 0.4).alias("end"), ((F.col("event_id") * 37 % 101) / 100.0).alias("sim"))


def _sizes(spark, d):
    return recordings(spark, d).groupBy("rec_id").agg(F.count("*").cast("int").alias("n_words"), (F.max("t") + 1).alias("duration"))


@query("merge_windows", with_("rec", "SELECT rec_id, min(word_lo) AS word_lo, max(word_hi) AS word_hi, round(min(t_lo), 6) AS t_lo, round(max(t_hi), 6) AS t_hi FROM base GROUP BY rec_id, win_ix // 2", _WINDOWS))
def merge_windows(spark, d):
    w = windows.base_windows(_anchors(spark, d), _sizes(spark, d))
    pair = w.groupBy("rec_id", F.floor(F.col("win_ix") / 2).alias("p")).agg(F.min_by("word_lo", "win_ix").alias("word_lo"), F.max_by("word_hi", "win_ix").alias("word_hi"), F.min_by("t_lo", "win_ix").alias("t_lo"), F.max_by("t_hi", "win_ix").alias("t_hi"))
    return pair.select("rec_id", "word_lo", "word_hi", r6(F.col("t_lo"), "t_lo"), r6(F.col("t_hi"), "t_hi"))


@query("base_windows", with_("rec", "SELECT rec_id, win_ix, word_lo, word_hi, round(t_lo, 6) AS t_lo, round(t_hi, 6) AS t_hi, sim_left, sim_right FROM base", _WINDOWS))
def base_windows(spark, d):
    w = windows.base_windows(_anchors(spark, d), _sizes(spark, d))
    return w.select("rec_id", "win_ix", "word_lo", "word_hi", r6(F.col("t_lo"), "t_lo"), r6(F.col("t_hi"), "t_hi"), "sim_left", "sim_right")


@query("build_windows", with_("rec", "SELECT rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY min(word_lo)) - 1 AS INT) AS win_ix, min(word_lo) AS word_lo, max(word_hi) AS word_hi, round(arg_min(t_lo, g), 6) AS t_lo, round(arg_max(t_hi, g), 6) AS t_hi FROM rest GROUP BY rec_id, h", {**_WINDOWS, **_MERGED}, True))
def build_windows(spark, d):
    w = windows.build_windows(_anchors(spark, d), _sizes(spark, d))
    return w.select("rec_id", "win_ix", "word_lo", "word_hi", r6(F.col("t_lo"), "t_lo"), r6(F.col("t_hi"), "t_hi"))


@query("interpolate_words", with_("rec", "SELECT rec_id, part, k AS word_ix, round(lo + span * (upto - n) / total, 6) AS start, round(lo + span * upto / total, 6) AS finish FROM (SELECT rec_id, k // 5 AS part, k, greatest(1, len(event_type)) AS n, sum(greatest(1, len(event_type))) OVER (PARTITION BY rec_id, k // 5 ORDER BY k) AS upto, sum(greatest(1, len(event_type))) OVER (PARTITION BY rec_id, k // 5) AS total, min(t) OVER p AS lo, greatest(0.0, max(t) OVER p - min(t) OVER p) AS span FROM rec WINDOW p AS (PARTITION BY rec_id, k // 5))"))
def interpolate_words(spark, d):
    part = F.floor(F.col("k") / 5).cast("int")
    r = recordings(spark, d).withColumn("part", part)
    p = Window.partitionBy("rec_id", "part")
    w = r.select("rec_id", "part", F.min("t").over(p).alias("t_lo"), F.max("t").over(p).alias("t_hi"), F.col("k").alias("word_ix"), F.col("event_type").alias("word"))
    return windows.interpolate_words(w, ["rec_id", "part"]).select("rec_id", "part", "word_ix", r6(F.col("start"), "start"), r6(F.col("end"), "finish"))


@query("weaker_side", with_("rec", "SELECT rec_id, win_ix, CASE WHEN coalesce(sim_left, -1.0) <= coalesce(sim_right, -1.0) THEN 'left' ELSE 'right' END AS side FROM base", _WINDOWS))
def weaker_side(spark, d):
    w = windows.base_windows(_anchors(spark, d), _sizes(spark, d))
    return w.select("rec_id", "win_ix", windows.weaker_side(F.col("sim_left"), F.col("sim_right")).alias("side"))


def _aligned(spark, d):
    """Windows aligned by a rule that fails for some: words evenly over the window's time."""

    def rule(w, text):
        if (w["word_lo"] + w["word_hi"]) % 4 == 0:
            return None
        step = (w["t_hi"] - w["t_lo"]) / len(text)
        return [(w["t_lo"] + i * step, w["t_lo"] + (i + 0.8) * step, 0.5) for i in range(len(text))]

    words = recordings(spark, d).select("rec_id", F.col("k").alias("word_ix"), F.col("event_type").alias("word"))
    return windows.align_windows(windows.build_windows(_anchors(spark, d), _sizes(spark, d)), words, rule)


@query("align_windows")
def align_windows(spark, d):
    return _aligned(spark, d)


@query("window_guards", with_("rec", "SELECT rec_id, event_id, value * 16000 / 320 >= (event_id % 60) * 1.1 + 4 AND (value / 3) <= 12.0 AS plausible FROM rec"))
def window_guards(spark, d):
    return recordings(spark, d).select("rec_id", "event_id", windows.guard_ok(F.col("value") * 16000, F.col("event_id") % 60, F.col("value") / 3).alias("plausible"))


# Words of overlapping windows: the first word of each window is also the last of the one before.
_OVER = "SELECT rec_id, k // 6 AS win_ix, k AS word_ix, t AS start, t + value / 50 AS end_, CAST(0.5 AS DOUBLE) AS score FROM rec UNION ALL SELECT rec_id, k // 6 - 1, k, t + 0.3, t + 0.1, CAST(0.4 AS DOUBLE) FROM rec WHERE k % 6 = 0 AND k > 0"


@query("stitch", with_("rec", "SELECT rec_id, word_ix, round(s, 6) AS start, round(greatest(end_, s), 6) AS finish, score FROM (SELECT *, max(start - word_ix * 0.02) OVER (PARTITION BY rec_id ORDER BY word_ix ROWS UNBOUNDED PRECEDING) + word_ix * 0.02 AS s FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, word_ix ORDER BY win_ix) AS r FROM over_) WHERE r = 1)", {"over_": _OVER}))
def stitch(spark, d):
    r = recordings(spark, d)
    w = F.floor(F.col("k") / 6).cast("int")
    one = r.select("rec_id", w.alias("win_ix"), F.col("k").alias("word_ix"), F.col("t").alias("start"), (F.col("t") + F.col("value") / 50).alias("end"), F.lit(0.5).alias("score"), F.lit(False).alias("interpolated"))
    two = r.where("k % 6 = 0 AND k > 0").select("rec_id", (w - 1).alias("win_ix"), F.col("k").alias("word_ix"), (F.col("t") + 0.3).alias("start"), (F.col("t") + 0.1).alias("end"), F.lit(0.4).alias("score"), F.lit(False).alias("interpolated"))
    s = windows.stitch(one.unionByName(two), _sizes(spark, d))
    return s.select("rec_id", "word_ix", r6(F.col("start"), "start"), r6(F.col("end"), "finish"), "score")


@query("monotone", with_("rec", "SELECT rec_id, k, round(max(value - k * 0.05) OVER (PARTITION BY rec_id ORDER BY k ROWS UNBOUNDED PRECEDING) + k * 0.05, 6) AS x FROM rec"))
def monotone(spark, d):
    w = Window.partitionBy("rec_id").orderBy("k")
    return recordings(spark, d).select("rec_id", "k", r6(windows.monotone(F.col("value"), F.col("k"), w, 0.05), "x"))


@query("backward_clamp", with_("rec", "SELECT rec_id, k, round(CASE WHEN k >= 1 THEN least(t, e - (n - k) * 0.05) ELSE t END, 6) AS x FROM (SELECT rec_id, k, t, count(*) OVER p AS n, max(t) OVER p * 0.9 AS e FROM rec WINDOW p AS (PARTITION BY rec_id))"))
def backward_clamp(spark, d):
    p = Window.partitionBy("rec_id")
    r = recordings(spark, d).withColumn("n", F.count("*").over(p)).withColumn("e", F.max("t").over(p) * 0.9)
    return r.select("rec_id", "k", r6(windows.clamp_back(F.col("t"), F.col("k"), F.col("n"), F.col("e")), "x"))


# Segments of four words of a recording.
_SEG = "SELECT rec_id, k // 4 AS seg_ix, CAST(count(*) AS INT) AS n_words, CAST(max(k // 12) AS INT) + 1 AS verse, string_agg(event_type, ' ' ORDER BY k) AS display, CAST(sum(len(event_type)) AS INT) AS letters, min(t) AS start, arg_max(t, k) + 0.4 AS end_ FROM rec GROUP BY rec_id, k // 4"


def _segments(spark, d):
    seg = F.floor(F.col("k") / 4).cast("int")
    g = recordings(spark, d).groupBy("rec_id", seg.alias("seg_ix")).agg(F.count("*").cast("int").alias("n_words"), (F.max(F.floor(F.col("k") / 12)).cast("int") + 1).alias("verse"), F.array_sort(F.collect_list(F.struct("k", "event_type"))).alias("w"), F.sum(F.length("event_type")).cast("int").alias("letters"), F.min("t").alias("start"), (F.max_by("t", "k") + 0.4).alias("end"))
    return g.withColumn("display", F.array_join(F.transform("w", lambda x: x["event_type"]), " ")).drop("w")


def _spans(spark, d):
    e = F.col("event_id")
    return recordings(spark, d).select("rec_id", F.col("k").alias("word_ix"), F.col("t").alias("start"), (F.col("t") + 0.4).alias("end"), ((e % 97) / 97.0).alias("score"), (e % 17 == 0).alias("interpolated"))


@query("segment_bounds", with_("rec", "SELECT rec_id, seg_ix, round(start, 6) AS start, round(end_, 6) AS finish FROM seg", {"seg": _SEG}))
def segment_bounds(spark, d):
    b = windows.segment_bounds(_segments(spark, d), _spans(spark, d))
    return b.select("rec_id", "seg_ix", r6(F.col("start"), "start"), r6(F.col("end"), "finish"))


def _clock_sql(x: str) -> str:
    ms = f"greatest(0, CAST(round_even({x} * 1000, 0) AS BIGINT))"
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


_CUE = "SELECT rec_id, CAST(row_number() OVER w AS INT) AS n, start, greatest(coalesce(lead(start) OVER w, end_ + 0.25), start + 0.3) AS end_, display FROM seg WINDOW w AS (PARTITION BY rec_id ORDER BY seg_ix)"


@query("srt_cues", with_("rec", "SELECT rec_id, n, round(start, 6) AS start, round(end_, 6) AS finish, display AS text FROM cue", {"seg": _SEG, "cue": _CUE}))
def srt_cues(spark, d):
    c = windows.srt_cues(_segments(spark, d))
    return c.select("rec_id", "n", r6(F.col("start"), "start"), r6(F.col("end"), "finish"), "text")


@query("srt_body", with_("rec", f"SELECT rec_id, string_agg(CAST(n AS VARCHAR) || chr(10) || {_clock_sql('start')} || ' --> ' || {_clock_sql('end_')} || chr(10) || display || chr(10), chr(10) ORDER BY n) AS body FROM cue GROUP BY rec_id", {"seg": _SEG, "cue": _CUE}))
def srt_body(spark, d):
    return windows.srt_body(windows.srt_cues(_segments(spark, d)))


@query("fmt_ts", f"SELECT event_id, {_clock_sql('(value * 123 - 50)')} AS stamp FROM events")
def fmt_ts(spark, d):
    return read(spark, d, "events").select("event_id", T.srt_time(F.col("value") * 123 - 50).alias("stamp"))


@query("report_clock", "SELECT event_id, printf('[%02d:%02d]', CAST(floor(value * 123) AS BIGINT) // 60, CAST(floor(value * 123) AS BIGINT) % 60) AS stamp FROM events")
def report_clock(spark, d):
    return read(spark, d, "events").select("event_id", T.clock(F.col("value") * 123).alias("stamp"))


@query("srt_reader", f"SELECT event_id, (greatest(0, CAST(round_even(value * 123000, 0) AS BIGINT))) // 1000 + (greatest(0, CAST(round_even(value * 123000, 0) AS BIGINT))) % 1000 / 1000.0 AS start FROM events")
def srt_reader(spark, d):
    lines = read(spark, d, "events").select("event_id", F.explode(F.array(F.col("event_id").cast("string"), F.concat(T.srt_time(F.col("value") * 123), F.lit(" --> 99:00:00,000")), F.lit("text"), F.lit(""))).alias("value"))
    return files.srt_starts(lines).select("event_id", "start")


@query("ground_truth", "SELECT event_id, line, CAST(trim(string_split(line, '#')[1]) AS DOUBLE) AS start FROM (SELECT event_id, printf('%8.2f', (event_id % 1000) * 0.25) || '  # פסוק ' || CAST(event_id % 9 AS VARCHAR) || ': ' || event_type AS line FROM events)")
def ground_truth(spark, d):
    line = files.truth_line((F.col("event_id") % 1000) * F.lit(0.25), F.col("event_id") % 9, F.col("event_type"))
    return files.truth_times(read(spark, d, "events").select("event_id", line.alias("line")), "line").select("event_id", "line", "start")


_FREE = "SELECT rec_id, k AS i, CASE WHEN k = 0 OR k % 6 = 0 OR k = max(k) OVER p THEN t END AS time, CAST(sum(length(event_type)) OVER (PARTITION BY rec_id ORDER BY k) AS INT) AS cum FROM rec WINDOW p AS (PARTITION BY rec_id)"


@query("interpolate_free", with_("rec", "SELECT rec_id, i, round(coalesce(time, a.time + (cum - a.cum) / (b.cum - a.cum) * (b.time - a.time)), 6) AS time FROM (SELECT *, last_value(CASE WHEN time IS NOT NULL THEN {'time': time, 'cum': cum} END IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS a, first_value(CASE WHEN time IS NOT NULL THEN {'time': time, 'cum': cum} END IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM free)", {"free": _FREE}))
def interpolate_free(spark, d):
    p = Window.partitionBy("rec_id")
    k = F.col("k")
    r = recordings(spark, d).select("rec_id", k.alias("i"), F.when((k % 6 == 0) | (k == F.max("k").over(p)), F.col("t")).alias("time"), F.sum(F.length("event_type")).over(p.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("cum"))
    return windows.interpolate_free(r).select("rec_id", "i", r6(F.col("time"), "time"))


# Signals: embeddings are short waves; hop and window in samples.
_DB = "SELECT vec_id, f, CAST(20 * log10(sqrt(list_sum(list_transform(embedding[f * 4 + 1 : f * 4 + 8], lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) / 8) + 1e-8) AS FLOAT) AS db FROM (SELECT vec_id, embedding, CAST(unnest(range((len(embedding) - 8) // 4 + 1)) AS INT) AS f FROM embeddings)"
_Q = "CAST(list_sort(dbs)[CAST(floor({0} * (len(dbs) - 1) + 0.5) AS INT) + 1] AS DOUBLE)"
_TH = f"SELECT vec_id, greatest({_Q.format('0.05')} + 6, {_Q.format('0.05')} + 0.3 * ({_Q.format('0.9')} - {_Q.format('0.05')})) AS th FROM (SELECT vec_id, list(db) AS dbs FROM db GROUP BY vec_id)"
_MASK = "SELECT vec_id, f, loud AND count(*) OVER (PARTITION BY vec_id, run) >= 2 AS is_speech FROM (SELECT *, sum(c) OVER (PARTITION BY vec_id ORDER BY f) AS run FROM (SELECT db.vec_id, f, CAST(db AS DOUBLE) > th AS loud, CASE WHEN lag(CAST(db AS DOUBLE) > th) OVER (PARTITION BY db.vec_id ORDER BY f) IS DISTINCT FROM (CAST(db AS DOUBLE) > th) THEN 1 ELSE 0 END AS c FROM db JOIN th USING (vec_id)))"


def _frames(spark, d):
    e = read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("rec_id"), F.posexplode(signal.frame_db(F.col("embedding"), 4, 8)).alias("frame", "db"))


@query("frame_db", "WITH db AS (" + _DB + ") SELECT vec_id AS rec_id, f AS frame, round(CAST(db AS DOUBLE), 3) AS db FROM db")
def frame_db(spark, d):
    return _frames(spark, d).select("rec_id", "frame", F.round(F.col("db").cast("double"), 3).alias("db"))


@query("frame_db_channels", "SELECT vec_id AS rec_id, f AS frame, round(CAST(CAST(20 * log10(sqrt(list_sum(list_transform(embedding[f * 8 + 1 : f * 8 + 16], lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) / 16) + 1e-8) AS FLOAT) AS DOUBLE), 3) AS db FROM (SELECT vec_id, embedding, CAST(unnest(range((len(embedding) // 2 - 8) // 4 + 1)) AS INT) AS f FROM embeddings)")
def frame_db_channels(spark, d):
    x = read(spark, d, "embeddings").select(F.col("vec_id").alias("rec_id"), F.posexplode("embedding").alias("p", "x"))
    samples = x.select("rec_id", (F.col("p") % 2).alias("channel"), F.floor(F.col("p") / 2).alias("i"), "x")
    return signal.frame_db_rows(samples, 4, 8).select("rec_id", "frame", F.round(F.col("db").cast("double"), 3).alias("db"))


@query("wave_samples", "SELECT vec_id AS rec_id, CAST(i - 1 AS INT) AS i, CAST(floor(CAST(embedding[i] AS DOUBLE) * 1000) / 32768.0 AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings WHERE len(embedding) = 64)")
def wave_samples(spark, d):
    # a wave of 64 samples for each embedding, header and all
    head = b"RIFF" + (36 + 128).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + b"".join(n.to_bytes(k, "little") for n, k in ((1, 2), (files.CHANNELS, 2), (files.RATE, 4), (files.RATE * 2, 4), (2, 2), (16, 2))) + b"data" + (128).to_bytes(4, "little")
    word = F.transform("embedding", lambda v: F.lpad(F.hex(F.pmod(F.floor(v.cast("double") * 1000), F.lit(65536))), 4, "0"))
    little = F.array_join(F.transform(word, lambda h: F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))), "")
    waves = read(spark, d, "embeddings").where(F.size("embedding") == 64).select(F.col("vec_id").cast("string").alias("path"), F.unhex(F.concat(F.lit(head.hex()), little)).alias("content"))
    got = files.wave_chunks(waves, 16).select(F.col("path").cast("long").alias("rec_id"), "chunk_ix", F.posexplode("samples").alias("p", "x"))
    return got.select("rec_id", (F.col("chunk_ix") * 16 + F.col("p")).alias("i"), F.col("x").cast("double").alias("x"))


# File listings: pages as files, most of them recordings.
@query("newest_recording", "SELECT folder, arg_max(name || page_id, {'a': changed, 'p': name || page_id}) AS path FROM (SELECT page_id, page_id % 7 AS folder, changed, CASE page_id % 4 WHEN 0 THEN 'a.mp3/' WHEN 1 THEN 'b.m4a/' WHEN 2 THEN 'c.wav/' ELSE 'notes.txt/' END AS name FROM (SELECT page_id, page_id % 13 AS changed FROM pages)) WHERE name <> 'notes.txt/' GROUP BY folder")
def newest_recording(spark, d):
    n = F.col("page_id") % 4
    name = F.when(n == 0, "a.mp3").when(n == 1, "b.m4a").when(n == 2, "c.wav").otherwise("notes.txt")
    listed = read(spark, d, "pages").select((F.col("page_id") % 7).alias("folder"), "page_id", (F.col("page_id") % 13).alias("modificationTime"), name.alias("path"))
    found = files.only_recordings(listed).withColumn("path", F.concat("path", F.lit("/"), F.col("page_id").cast("string")))
    return files.newest(found, ["folder"])


@query("speech_threshold", f"WITH db AS ({_DB}), th AS ({_TH}) SELECT vec_id AS rec_id, round(th, 3) AS threshold FROM th")
def speech_threshold(spark, d):
    return _frames(spark, d).groupBy("rec_id").agg(F.round(signal.speech_threshold(F.collect_list("db")), 3).alias("threshold"))


@query("speech_mask", f"WITH db AS ({_DB}), th AS ({_TH}), mask AS ({_MASK}) SELECT vec_id AS rec_id, f AS frame, is_speech FROM mask")
def speech_mask(spark, d):
    return signal.speech_mask(_frames(spark, d), 2)


# Pauses: an event of a recording is speech unless it is of two kinds.
_SPEECH = "SELECT rec_id, k, event_type NOT IN ('click', 'error') AS s FROM rec"


@query("find_pauses", with_("rec", "SELECT rec_id, CAST(min(k) * 0.1 AS DOUBLE) AS start, CAST((max(k) + 1) * 0.1 AS DOUBLE) AS finish FROM (SELECT *, sum(c) OVER (PARTITION BY rec_id ORDER BY k) AS run FROM (SELECT *, CASE WHEN lag(s) OVER (PARTITION BY rec_id ORDER BY k) IS DISTINCT FROM s THEN 1 ELSE 0 END AS c FROM (SELECT *, min(CASE WHEN s THEN k END) OVER (PARTITION BY rec_id) AS a, max(CASE WHEN s THEN k END) OVER (PARTITION BY rec_id) AS z FROM speech) WHERE k BETWEEN a AND z)) WHERE NOT s GROUP BY rec_id, run HAVING (max(k) + 1 - min(k)) * 0.1 >= 0.22", {"speech": _SPEECH}))
def find_pauses(spark, d):
    mask = recordings(spark, d).select("rec_id", F.col("k").alias("frame"), (~F.col("event_type").isin("click", "error")).alias("is_speech"))
    p = signal.find_pauses(mask, 0.1, 0.22)[0]
    return p.select("rec_id", "start", F.col("end").alias("finish"))


_SNAP = "SELECT b.rec_id, b.k AS seg_ix, b.t, arg_min(o.t, {'d': abs(o.t - b.t), 't': o.t}) AS o, CASE WHEN b.k % 3 = 0 THEN 1.4 ELSE 0.7 END AS reach FROM rec b LEFT JOIN (SELECT rec_id, t FROM rec WHERE event_type = 'view') o ON o.rec_id = b.rec_id WHERE b.event_type = 'click' GROUP BY b.rec_id, b.k, b.t"


@query("snap_boundaries", with_("rec", "SELECT rec_id, seg_ix, round(greatest(x, m), 6) AS start, CASE WHEN m <= x + 1e-9 THEN round(snap, 6) END AS snap FROM (SELECT *, max(x - i * 0.02) OVER w + i * 0.02 AS m FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY seg_ix) AS i, CASE WHEN abs(o - t) <= reach THEN o ELSE t END AS x, CASE WHEN abs(o - t) <= reach THEN abs(o - t) END AS snap FROM near) WINDOW w AS (PARTITION BY rec_id ORDER BY i ROWS UNBOUNDED PRECEDING))", {"near": _SNAP}))
def snap_boundaries(spark, d):
    r = recordings(spark, d)
    b = r.where("event_type = 'click'").select("rec_id", F.col("k").alias("seg_ix"), F.col("t").alias("start"), (F.col("k") % 3 == 0).alias("opens_verse"))
    o = r.where("event_type = 'view'").select("rec_id", "t")
    s = signal.snap_boundaries(b, o, radius=0.7, verse_radius=1.4)
    return s.select("rec_id", "seg_ix", r6(F.col("start"), "start"), r6(F.col("snap"), "snap"))


@query("text_weights", with_("rec", "SELECT rec_id, k, CASE WHEN event_id % 6 = 0 THEN 1 ELSE event_id % 6 END + 2 + CASE WHEN event_id % 4 = 0 THEN 5 ELSE 0 END AS weight FROM rec"))
def text_weights(spark, d):
    e = F.col("event_id")
    return recordings(spark, d).select("rec_id", "k", T.text_weight(e % 6, e % 4 == 0).alias("weight"))


@query("analyze_timing")
def analyze_timing(spark, d):
    r = recordings(spark, d)
    mask = r.select("rec_id", F.col("k").alias("frame"), (~F.col("event_type").isin("click", "error")).alias("is_speech"))
    pauses, bounds = signal.find_pauses(mask, 0.1, 0.15)
    n = r.groupBy("rec_id").agg((F.count("*") * 0.1).alias("duration"))
    s = _segments(spark, d).select("rec_id", "seg_ix", "letters", (F.col("seg_ix") % 3 == 2).alias("verse_end"))
    return signal.analyze(s, pauses, bounds.join(n, "rec_id"))


@query("word_spans", with_("rec", "SELECT rec_id, k // 3 AS word_ix, round(min(t), 6) AS start, round(max(t), 6) AS finish, round(avg(value), 6) AS score FROM rec GROUP BY rec_id, k // 3"))
def word_spans(spark, d):
    g = recordings(spark, d).groupBy("rec_id", F.floor(F.col("k") / 3).cast("int").alias("word_ix"))
    return g.agg(r6(F.min("t"), "start"), r6(F.max("t"), "finish"), r6(F.avg("value"), "score"))


# Quality.
_RANGE = "SELECT rec_id, seg_ix, CAST(sum(n_words) OVER w - n_words AS INT) AS lo, CAST(sum(n_words) OVER w - 1 AS INT) AS hi FROM seg WINDOW w AS (PARTITION BY rec_id ORDER BY seg_ix)"


@query("word_ranges", with_("rec", "SELECT rec_id, seg_ix, lo, hi FROM range_", {"seg": _SEG, "range_": _RANGE}))
def word_ranges(spark, d):
    return quality.word_ranges(_segments(spark, d)).select("rec_id", "seg_ix", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"))


@query("verse_start_flags", with_("rec", "SELECT rec_id, seg_ix, verse IS DISTINCT FROM lag(verse) OVER (PARTITION BY rec_id ORDER BY seg_ix) AS opens_verse FROM seg", {"seg": _SEG}))
def verse_start_flags(spark, d):
    return quality.verse_start_flags(_segments(spark, d))


@query("anchor_distances", with_("rec", "SELECT r.rec_id, r.seg_ix, min(CASE WHEN ref IS NOT NULL THEN greatest(lo - ref, ref - hi, 0) END) :: BIGINT AS anchor_dist FROM range_ r LEFT JOIN (SELECT rec_id, k AS ref FROM rec WHERE k % 25 = 9) a ON a.rec_id = r.rec_id GROUP BY r.rec_id, r.seg_ix", {"seg": _SEG, "range_": _RANGE}))
def anchor_distances(spark, d):
    a = recordings(spark, d).where("k % 25 = 9").select("rec_id", F.col("k").alias("ref"))
    return quality.anchor_distances(quality.word_ranges(_segments(spark, d)), a)


@query("asr_gaps", with_("rec", "SELECT r.rec_id, r.seg_ix, round(list_sort(list(abs(value / 10)) FILTER (k % 3 <> 1))[CAST(count_if(k % 3 <> 1) // 2 AS INT) + 1], 6) AS asr_gap FROM range_ r JOIN rec ON rec.rec_id = r.rec_id AND k BETWEEN lo AND hi GROUP BY r.rec_id, r.seg_ix", {"seg": _SEG, "range_": _RANGE}))
def asr_gaps(spark, d):
    r = recordings(spark, d).where("k % 3 != 1")
    # of two matches of a word the later one counts
    m = r.select("rec_id", F.col("k").alias("ref"), F.explode(F.array(F.struct(F.lit(99.0).alias("s"), F.lit(0).alias("k")), F.struct((F.col("t") + F.col("value") / 10).alias("s"), F.lit(1).alias("k")))).alias("m")).select("rec_id", "ref", F.col("m.s").alias("asr_start"), F.col("m.k").alias("k"))
    g = quality.heard_gaps(quality.word_ranges(_segments(spark, d)), m, _spans(spark, d))
    return g.select("rec_id", "seg_ix", r6(F.col("asr_gap"), "asr_gap"))


@query("segment_ctc_scores", with_("rec", "SELECT rec_id, k // 4 AS seg_ix, round(avg((event_id % 97) / 97.0), 6) AS ctc_score FROM rec GROUP BY rec_id, k // 4"))
def segment_ctc_scores(spark, d):
    s = quality.segment_signals(quality.word_ranges(_segments(spark, d)), _spans(spark, d))
    return s.select("rec_id", "seg_ix", r6(F.col("ctc_score"), "ctc_score"))


@query("segment_interpolated", with_("rec", "SELECT rec_id, k // 4 AS seg_ix, bool_or(event_id % 17 = 0) AS interpolated FROM rec GROUP BY rec_id, k // 4"))
def segment_interpolated(spark, d):
    return quality.segment_signals(quality.word_ranges(_segments(spark, d)), _spans(spark, d)).select("rec_id", "seg_ix", "interpolated")


_SIGNAL = "SELECT event_id, user_id AS rec_id, event_type, CASE WHEN event_id % 23 = 0 THEN NULL ELSE (event_id % 97) / 97.0 END AS score, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 71 END AS dist, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 31) / 11.0 END AS gap, CASE event_id % 3 WHEN 1 THEN true WHEN 2 THEN false END AS snapped, event_id % 17 = 0 AS interpolated FROM events"
_TOTAL = "0.35 * coalesce(least(1.0, greatest(0.0, score)), 0.5) + 0.25 * coalesce(greatest(0.0, 1 - dist / 50.0), 0.0) + 0.2 * CASE WHEN gap IS NULL THEN 0.5 WHEN gap <= 0.5 THEN 1.0 ELSE greatest(0.0, 1 - (gap - 0.5) / 1.5) END + 0.2 * CASE WHEN snapped IS NULL THEN 0.5 WHEN snapped THEN 1.0 ELSE 0.4 END"
_CONF = f"CAST(printf('%.3f', CASE WHEN interpolated THEN least(0.3, {_TOTAL}) ELSE {_TOTAL} END) AS DOUBLE)"
_R = quality.REASONS
_WHY = f"coalesce(nullif(concat_ws('; ', CASE WHEN interpolated THEN '{_R['interpolated']}' END, CASE WHEN dist IS NULL OR dist >= 50 THEN '{_R['anchor']}' END, CASE WHEN gap > 2.0 THEN printf('{_R['gap'].replace('%s', '%.1f')}', gap) END, CASE WHEN NOT snapped THEN '{_R['voice']}' END, CASE WHEN score < 0.2 THEN '{_R['score']}' END), ''), '—')"


def _signals(spark, d):
    e = F.col("event_id")
    return read(spark, d, "events").select("event_id", F.col("user_id").alias("rec_id"), "event_type", F.when(e % 23 != 0, (e % 97) / 97.0).alias("score"), F.when(e % 9 != 0, e % 71).alias("dist"), F.when(e % 7 != 0, (e % 31) / 11.0).alias("gap"), F.when(e % 3 == 1, True).when(e % 3 == 2, False).alias("snapped"), (e % 17 == 0).alias("interpolated"))


_COLS = ["score", "dist", "gap", "snapped", "interpolated"]


@query("score_segments", f"WITH sig AS ({_SIGNAL}) SELECT event_id, {_CONF} AS confidence FROM sig")
def score_segments(spark, d):
    return _signals(spark, d).select("event_id", quality.confidence(*map(F.col, _COLS)).alias("confidence"))


@query("reasons", f"WITH sig AS ({_SIGNAL}) SELECT event_id, {_WHY} AS reasons FROM sig")
def reasons(spark, d):
    return _signals(spark, d).select("event_id", quality.reasons(*map(F.col, _COLS)).alias("reasons"))


_REPORT = f"SELECT rec_id, '{quality.TITLE}' || chr(10) || '{quality.RULE}' || chr(10) || printf('{quality.SUMMARY.replace('%s', '%.2f')}', count(*), list_sort(list(c))[CAST(count(*) // 2 AS INT) + 1], count_if(c < 0.5)) || chr(10) || chr(10) || CASE WHEN count_if(c < 0.5) = 0 THEN '{quality.ALL_WELL}' ELSE '{quality.LOW_ONES % quality.LOW}' || chr(10) || string_agg(printf('  [%02d:%02d] פסוק %s | ביטחון %.2f | %s', event_id // 60, event_id % 60, CAST(event_id % 5 AS VARCHAR), c, event_type) || chr(10) || '        סיבה: ' || why, chr(10) ORDER BY event_id) FILTER (c < 0.5) END AS report FROM (SELECT *, {_CONF} AS c, {_WHY} AS why FROM sig) GROUP BY rec_id"


@query("format_report", f"WITH sig AS ({_SIGNAL}) {_REPORT}")
def format_report(spark, d):
    s = _signals(spark, d)
    rows = s.select("rec_id", F.col("event_id").alias("seg_ix"), (F.col("event_id") % 5).alias("verse"), F.col("event_id").cast("double").alias("start"), F.col("event_type").alias("display"), quality.confidence(*map(F.col, _COLS)).alias("confidence"), quality.reasons(*map(F.col, _COLS)).alias("reasons"))
    return quality.report(rows)


@query("report_file", f"WITH sig AS ({_SIGNAL}), rep AS ({_REPORT}) SELECT rec_id, printf('מודל תמלול: %s | כיסוי: %d%% | עוגנים: %d | חלונות: %d', 'table', 90, CAST(rec_id % 7 AS BIGINT), 3) || chr(10) || chr(10) || report AS body FROM rep")
def report_file(spark, d):
    r = format_report(spark, d)
    head = F.format_string("מודל תמלול: %s | כיסוי: %d%% | עוגנים: %d | חלונות: %d", F.lit("table"), F.lit(90), F.col("rec_id") % 7, F.lit(3))
    return r.select("rec_id", F.concat(head, F.lit("\n\n"), "report").alias("body"))


# Three methods of timing against the truth, by rule.
_PRED = "SELECT m.method, o_orderkey AS seg_ix, o_totalprice / 1000 + CASE m.method WHEN 'even' THEN (o_custkey % 41 - 20) / 9.0 WHEN 'single' THEN (o_custkey % 17 - 8) / 7.0 ELSE (o_custkey % 9 - 4) / 13.0 END AS p, o_totalprice / 1000 AS t FROM orders, (SELECT unnest(['even', 'single', 'hybrid']) AS method) m"
_METRIC = "SELECT method, count(*) AS n, round(list_sort(list(abs(p - t)))[CAST(count(*) // 2 AS INT) + 1], 6) AS median_abs, round(max(abs(p - t)), 6) AS max_abs, round(100.0 * count_if(abs(p - t) <= 0.5) / count(*), 6) AS pct_within_05, round(100.0 * count_if(abs(p - t) <= 1.0) / count(*), 6) AS pct_within_10, CAST(count_if(p - t < -0.2) AS BIGINT) AS early, CAST(count_if(p - t > 0.2) AS BIGINT) AS late FROM pred GROUP BY method"


def _errors(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("seg_ix"), (F.col("o_totalprice") / 1000).alias("t"), "o_custkey")
    c = F.col("o_custkey")
    off = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), x.alias("x")) for m, x in (("even", (c % 41 - 20) / 9.0), ("single", (c % 17 - 8) / 7.0), ("hybrid", (c % 9 - 4) / 13.0))]))
    p = o.select("seg_ix", "t", off.alias("o")).select("o.method", "seg_ix", (F.col("t") + F.col("o.x")).alias("start"))
    return quality.boundary_errors(p, o.select("seg_ix", F.col("t").alias("start")))


@query("boundary_errors", f"WITH pred AS ({_PRED}) SELECT method, seg_ix, round(p - t, 6) AS error FROM pred")
def boundary_errors(spark, d):
    return _errors(spark, d).select("method", "seg_ix", r6(F.col("error"), "error"))


def _metrics(spark, d):
    m = quality.error_metrics(_errors(spark, d))
    return m.select("method", "n", *[r6(F.col(x), x) for x in ("median_abs", "max_abs", "pct_within_05", "pct_within_10")], "early", "late")


@query("error_metrics", f"WITH pred AS ({_PRED}) {_METRIC}")
def error_metrics(spark, d):
    return _metrics(spark, d)


@query("comparison_table", f"WITH pred AS ({_PRED}), m AS ({_METRIC}) SELECT method, printf('%-24s %9.1f%% %9.1f%% %7.2fs %7.2fs %6d %6d', method, pct_within_05, pct_within_10, median_abs, max_abs, early, late) AS line FROM m")
def comparison_table(spark, d):
    return quality.comparison_lines(_metrics(spark, d))


@query("comparison_text", f"WITH pred AS ({_PRED}), m AS ({_METRIC}) SELECT '{quality.COMPARISON}' || chr(10) || repeat('=', {len(quality.COMPARISON_HEAD)}) || chr(10) || '{quality.COMPARISON_HEAD}' || chr(10) || repeat('-', {len(quality.COMPARISON_HEAD)}) || chr(10) || string_agg(printf('%-24s %9.1f%% %9.1f%% %7.2fs %7.2fs %6d %6d', method, pct_within_05, pct_within_10, median_abs, max_abs, early, late), chr(10) ORDER BY method) || chr(10) || chr(10) || '{quality.COMPARISON_GOAL}' AS \"table\" FROM m")
def comparison_text(spark, d):
    return quality.comparison_text(_metrics(spark, d), "method")


@query("equal_split_baseline", with_("rec", "SELECT rec_id, seg_ix, round(120.0 * (sum(greatest(1, letters)) OVER w - greatest(1, letters)) / sum(greatest(1, letters)) OVER (PARTITION BY rec_id), 6) AS start FROM seg WINDOW w AS (PARTITION BY rec_id ORDER BY seg_ix)", {"seg": _SEG}))
def equal_split_baseline(spark, d):
    s = quality.equal_split(_segments(spark, d).withColumn("duration", F.lit(120.0)))
    return s.select("rec_id", "seg_ix", r6(F.col("start"), "start"))


@query("run_counters", with_("rec", "SELECT rec_id, count(DISTINCT k // 12) AS verses, count(DISTINCT k // 4) AS segments, count(*) AS words, CAST(count_if(k % 10 = 3) AS BIGINT) AS anchors, CAST(count_if(event_id % 17 = 0) AS BIGINT) AS interpolated FROM rec GROUP BY rec_id"))
def run_counters(spark, d):
    s = _segments(spark, d).groupBy("rec_id").agg(F.count_distinct("verse").alias("verses"), F.count("*").alias("segments"), F.sum("n_words").alias("words"))
    x = _spans(spark, d).groupBy("rec_id").agg(F.count_if(F.col("word_ix") % 10 == 3).alias("anchors"), F.count_if("interpolated").alias("interpolated"))
    return s.join(x, "rec_id")
