"""Alignment, windows, signals, quality and files on small cases and against plain loops."""

import math
import random
import time
import wave

import pytest
from pyspark.sql import functions as F

from melisma.operators import align, quality, signal, windows
from melisma.sources import files

R = "rec_id string, "


def test_word_similarity(spark):
    assert align.similarity("כוהנימ", "כהנימ") >= 0.9 and align.similarity("אב", "אבגדהוזחט") == 0 and align.similarity("", "א") == 0 and align.similarity("א", "א") == 1
    pairs = [("כוהנימ", "כהנימ"), ("אב", "אבגדהוזחט"), ("", "א"), ("אבג", "אבד"), ("וו", "י")]
    d = spark.createDataFrame(pairs, "a string, b string").select("a", "b", align.word_similarity(F.col("a"), F.col("b")).alias("s"))
    assert all(math.isclose(r["s"], align.similarity(r["a"], r["b"])) for r in d.collect())


def brute_distance(a, b):
    cost = lambda c: 0.25 if c in "וי" else 1.0
    t = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                t[i][j] = min(([t[i - 1][j] + cost(a[i - 1])] if i else []) + ([t[i][j - 1] + cost(b[j - 1])] if j else []) + ([t[i - 1][j - 1] + (a[i - 1] != b[j - 1])] if i and j else []))
    return t[-1][-1]


def test_distance_and_alignment_against_full_tables():
    r = random.Random(2)
    for _ in range(200):
        a, b = ("".join(r.choices("אבוי", k=r.randrange(7))) for _ in range(2))
        assert math.isclose(align.weighted_distance(a, b), brute_distance(a, b))
    a, b = (["".join(r.choices("אבגוי", k=r.randrange(8))) for _ in range(500)] for _ in range(2))
    assert align.weighted_distances(a, b, 64).tolist() == [align.weighted_distance(x, y) for x, y in zip(a, b)]
    for _ in range(60):
        x, y = (["".join(r.choices("אבג", k=r.randrange(1, 4))) for _ in range(r.randrange(8))] for _ in range(2))
        pairs = align.align_words(x, y)
        best = {}
        for i in range(len(x) + 1):
            for j in range(len(y) + 1):
                options = [best[i - 1, j] + align.GAP] if i else []
                options += [best[i, j - 1] + align.GAP] if j else []
                if i and j:
                    s = align.similarity(x[i - 1], y[j - 1])
                    options.append(best[i - 1, j - 1] + (s if s >= 0.5 else -0.5))
                best[i, j] = max(options, default=0.0)
        score = sum(align.GAP if i is None or j is None else (s if s >= 0.5 else -0.5) for i, j, s in pairs)
        assert math.isclose(score, best[len(x), len(y)], abs_tol=1e-9)
        assert [i for i, _, _ in pairs if i is not None] == list(range(len(x))) and [j for _, j, _ in pairs if j is not None] == list(range(len(y)))


WORDS = ["בראשית", "ברא", "אלהים", "את", "השמים", "ואת", "הארץ"]


def test_alignments():
    assert [(i, j) for i, j, _ in align.align_words(WORDS, WORDS)] == [(i, i) for i in range(7)]
    assert [(i, j) for i, j, _ in align.align_words([WORDS[0], *WORDS[2:]], WORDS)][:3] == [(0, 0), (None, 1), (1, 2)]
    assert (1, None) in [(i, j) for i, j, _ in align.align_words([WORDS[0], "קקקקק", *WORDS[1:]], WORDS)]
    far = align.align_words(["א"], ["ב"] * 700, 5)
    assert sorted(j for _, j, _ in far if j is not None) == list(range(700))


def test_many_recordings_at_once():
    r = random.Random(5)
    words = ["", "ו", *("".join(r.choice("אבגדהוי") for _ in range(r.randint(1, 9))) for _ in range(60))]

    def several(sizes):
        return [[r.choice(words) for _ in range(r.choice(sizes))] for _ in range(120)]

    def listed(heard, known, band):
        out = {}
        for which, size, i, j, s in align.align_lists(heard, known, band):
            ends = size.cumsum().tolist()
            for x, n, z in zip(which.tolist(), size.tolist(), ends, strict=True):
                out[x] = [(None if a < 0 else a, None if b < 0 else b, c) for a, b, c in zip(*(v[z - n : z].tolist() for v in (i, j, s)), strict=True)]
        return [out[x] for x in range(len(heard))]

    for band in (align.BAND, 7, 3, 1):
        heard, known = several([0, 1, 2, 6, 20, 40]), several([0, 1, 3, 7, 25, 90])
        assert listed(heard, known, band) == [align.align_words(a, b, band) for a, b in zip(heard, known, strict=True)]
    known = several([150])
    heard = [x[3:60] + x[62:] for x in known]
    listed(heard, known, 20)
    start = time.perf_counter()
    got = listed(heard, known, 250)
    middle = time.perf_counter()
    assert got == [align.align_words(a, b, 250) for a, b in zip(heard, known, strict=True)]
    assert 2 * (middle - start) < time.perf_counter() - middle


def test_anchor_filters():
    assert align.longest_increasing([1, 2, 99, 4, 5]) == [0, 1, 3, 4] and align.longest_increasing([]) == [] and align.longest_increasing([2, 1]) == [0]
    a = [{"ref": i, "start": t, "end": t + 0.4, "sim": s} for i, (t, s) in enumerate([(0, 0.9), (1, 0.9), (61, 0.86)])]
    assert [x["ref"] for x in align.enforce_rate(a)] == [0, 1]
    r = random.Random(4)

    def restart(x):
        x = list(x)
        while True:
            for i in range(len(x) - 1):
                pace = max(x[i + 1]["end"] - x[i]["end"], 1e-6) / max(x[i + 1]["ref"] - x[i]["ref"], 1)
                if not 0.12 <= pace <= 4:
                    del x[i if x[i]["sim"] <= x[i + 1]["sim"] else i + 1]
                    break
            else:
                return x

    for _ in range(300):
        t, x = 0.0, []
        for i in range(r.randrange(12)):
            t += r.choice([0.01, 0.5, 1, 9])
            x.append({"ref": i * r.choice([1, 2]), "start": t, "end": t, "sim": r.choice([0.8, 0.9])})
        assert align.enforce_rate(x) == restart(x)


def test_anchors_end_to_end(spark):
    heard = spark.createDataFrame([("r", i, w, i * 0.6, i * 0.6 + 0.5) for i, w in enumerate(WORDS)], R + "ix int, word string, start double, end double")
    known = spark.createDataFrame([("r", i, w) for i, w in enumerate(WORDS)], R + "ix int, word string")
    f = align.find_anchors(heard, known)
    refs = [r["ref"] for r in f["anchors"].orderBy("ref").collect()]
    assert {0, 2, 6} <= set(refs) and f["coverage"].first()["coverage"] >= 0.9 and f["matches"].count() == 7
    none = align.find_anchors(heard.limit(0), known)
    assert none["anchors"].count() == 0 and none["coverage"].first()["coverage"] == 0


def test_repeats(spark):
    k = spark.createDataFrame([("r", i, w) for i, w in enumerate("א ב ג ב ד ה ו א".split())], R + "ix int, word string")
    assert {r["ix"] for r in align.repeated_nearby(k).where("repeated").collect()} == {0, 1, 3, 7}
    assert {r["ix"] for r in align.repeated_nearby(k, radius=2).where("repeated").collect()} == {1, 3}


def windows_of(spark, anchors, n, duration, least=0.0):
    a = spark.createDataFrame([("r", *x) for x in anchors], R + "ref int, start double, end double, sim double")
    s = spark.createDataFrame([("r", n, duration)], R + "n_words int, duration double")
    return [tuple(r)[2:] for r in windows.build_windows(a, s, least=least).orderBy("win_ix").collect()]


def test_windows(spark):
    assert windows_of(spark, [], 10, 60.0) == [(0, 9, 0.0, 60.0, None, None)]
    w = windows_of(spark, [(5, 10.0, 10.5, 0.9), (12, 30.0, 30.5, 0.8)], 20, 60.0)
    assert [x[:2] for x in w] == [(0, 5), (5, 12), (12, 19)] and w[1][2:4] == (9.5, 31.0) and w[0][5] == 0.9
    assert windows_of(spark, [(0, 1.0, 1.5, 0.9)], 1, 60.0) == [(0, 0, 0.5, 60.0, 0.9, None)]
    assert windows_of(spark, [], 0, 60.0) == []
    m = windows_of(spark, [(3, 10.0, 10.5, 0.9), (4, 11.0, 11.5, 0.9), (10, 40.0, 40.5, 0.9)], 20, 60.0, 8.0)
    assert all(x[3] - x[2] >= 8 for x in m) and m[0][0] == 0 and m[-1][1] == 19


def test_short_windows_against_restarts(spark):
    r = random.Random(6)
    chains = {}
    for c in range(60):
        edges = sorted(r.sample(range(100), r.randrange(2, 9)))
        chains["c%d" % c] = [(i, a, b, float(a), float(b), None, None) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]
    d = spark.createDataFrame([(c, *w) for c, ws in chains.items() for w in ws], R + "win_ix int, word_lo int, word_hi int, t_lo double, t_hi double, sim_left double, sim_right double")
    got = {}
    for x in windows.merge_short(d, least=12.0).orderBy("rec_id", "win_ix").collect():
        got.setdefault(x["rec_id"], []).append((x["word_lo"], x["word_hi"]))
    for c, ws in chains.items():
        w = [(a, b) for _, a, b, *_ in ws]
        while len(w) > 1:
            i = next((i for i, (a, b) in enumerate(w) if b - a < 12), None)
            if i is None:
                break
            j = i if i + 1 < len(w) else i - 1
            w[j : j + 2] = [(w[j][0], w[j + 1][1])]
        assert got[c] == w


def chain(n):
    return [{"win_ix": i, "word_lo": 5 * i, "word_hi": 5 * i + 5, "t_lo": 10.0 * i, "t_hi": 10.0 * i + 10, "sim_left": 0.9, "sim_right": 0.8} for i in range(n)]


def test_repairs():
    words = ["w"] * 16
    spans = lambda w: [(w["t_lo"], w["t_hi"], 1.0)] * (w["word_hi"] - w["word_lo"] + 1)
    middle = windows.repair_windows(chain(3), lambda w: None if (w["word_lo"], w["word_hi"]) == (5, 10) else spans(w), words)
    assert [(w["word_lo"], w["word_hi"], f) for w, _, f in middle] == [(0, 5, False), (5, 15, False)]
    none = windows.repair_windows(chain(3), lambda w: None, words)
    assert all(f for *_, f in none) and sum(len(s) for _, s, _ in none) == 18
    left = windows.repair_windows(chain(2), lambda w: None if w["word_lo"] == 5 else spans(w), words)
    assert [(w["word_lo"], w["word_hi"]) for w, _, _ in left] == [(0, 10)]


def test_guards_at_their_bounds(spark):
    rows = [(n, frames * 320.0, longest, ok) for n, frames, longest, ok in [(25, 31.5, 1.0, True), (45, 53.5, None, True), (50, 59.0, 12.0, True), (25, 31.49, 1.0, False), (0, 4.0, 1.0, True), (50, 59.0, 12.01, False)]]
    d = spark.createDataFrame(rows, "n long, samples double, longest double, ok boolean")
    assert all(r["got"] == r["ok"] for r in d.select("ok", windows.guard_ok(F.col("samples"), F.col("n"), F.col("longest")).alias("got")).collect())


def test_interpolation_and_stitching(spark):
    w = spark.createDataFrame([("r", 0.0, 10.0, 0, "אב"), ("r", 0.0, 10.0, 1, "אבגדהוזח")], R + "t_lo double, t_hi double, word_ix int, word string")
    got = windows.interpolate_words(w, ["rec_id"]).orderBy("word_ix").collect()
    assert (got[0]["end"], got[1]["start"], got[1]["end"]) == (2.0, 2.0, 10.0)
    a = spark.createDataFrame([("r", 0, 0, 0.0, 1.0, 1.0, False), ("r", 0, 1, 1.0, 2.0, 1.0, False), ("r", 1, 1, 5.0, 6.0, 0.1, False), ("r", 1, 2, 0.5, 0.6, 1.0, False)], R + "win_ix int, word_ix int, start double, end double, score double, interpolated boolean")
    size = lambda n: spark.createDataFrame([("r", n)], R + "n_words int")
    s = windows.stitch(a, size(3)).orderBy("word_ix").collect()
    assert [round(x["start"], 6) for x in s] == [0.0, 1.0, 1.02] and s[1]["score"] == 1.0 and s[2]["end"] == s[2]["start"]
    with pytest.raises(Exception, match="do not cover"):
        windows.stitch(a, size(4)).collect()


def test_subtitles(spark, tmp_path):
    b = spark.createDataFrame([("r", 0, 1.0, 2.0, "a"), ("r", 1, 1.1, 3.0, "b"), ("r", 2, 5.0, 6.0, "c")], R + "seg_ix int, start double, end double, display string")
    cues = windows.srt_cues(b)
    assert [(x["start"], round(x["end"], 3)) for x in cues.orderBy("n").collect()] == [(1.0, 1.3), (1.1, 5.0), (5.0, 6.25)]
    files.write_texts(windows.srt_body(cues), str(tmp_path / "srt"), "body", bom=True)
    assert [x["start"] for x in files.read_srt(spark, str(tmp_path / "srt")).orderBy("start").collect()] == [1.0, 1.1, 5.0]
    raw = next((tmp_path / "srt").rglob("part-*")).read_text(encoding="utf-8")
    assert raw.startswith("﻿1\n00:00:01,000 --> 00:00:01,300\na\n\n2\n")


def test_snapping(spark):
    s = spark.createDataFrame([("r", 0, 0.1, True), ("r", 1, 5.0, False), ("r", 2, 10.0, False), ("q", 0, 3.0, False)], R + "seg_ix int, start double, opens_verse boolean")
    o = spark.createDataFrame([("r", 0.0), ("r", 5.2), ("r", 10.3)], R + "t double")
    got = {(x["rec_id"], x["seg_ix"]): (x["start"], x["snap"]) for x in signal.snap_boundaries(s, o).collect()}
    assert got["r", 1][0] == 5.2 and got["r", 2][0] == 10.3 and got["q", 0] == (3.0, None) and math.isclose(got["r", 0][1], 0.1)
    far = spark.createDataFrame([("r", 0, 5.0, True), ("r", 1, 9.0, False)], R + "seg_ix int, start double, opens_verse boolean")
    got = signal.snap_boundaries(far, spark.createDataFrame([("r", 5.6), ("r", 9.6)], R + "t double")).orderBy("seg_ix").collect()
    assert got[0]["start"] == 5.6 and got[1]["start"] == 9.0 and got[1]["snap"] is None
    tie = signal.snap_boundaries(far.limit(1), spark.createDataFrame([("r", 4.5), ("r", 5.5)], R + "t double")).first()
    assert tie["start"] == 4.5


def brute_match(expected, pauses, skip, bonus):
    import itertools

    best = math.inf
    for k in range(min(len(expected), len(pauses)) + 1):
        for b in itertools.combinations(range(len(expected)), k):
            for p in itertools.combinations(range(len(pauses)), k):
                c = skip * (len(expected) - k) + sum(max(0.0, abs(expected[i] - pauses[j][0]) - bonus * min(pauses[j][1], 1.5)) for i, j in zip(b, p))
                best = min(best, c)
    return best


def test_matching_pauses_costs_least():
    r = random.Random(8)
    for _ in range(150):
        e, p = sorted(r.uniform(0, 10) for _ in range(r.randrange(5))), sorted((r.uniform(0, 10), r.uniform(0.2, 2)) for _ in range(r.randrange(6)))
        m = signal.match_pauses(e, p, 2.0, 0.4)
        cost = sum(2.0 if j < 0 else max(0.0, abs(x - p[j][0]) - 0.4 * min(p[j][1], 1.5)) for x, j in zip(e, m))
        assert math.isclose(cost, brute_match(e, p, 2.0, 0.4), abs_tol=1e-9)
        used = [j for j in m if j >= 0]
        assert used == sorted(set(used))


LETTERS = [12, 9, 16, 8, 14, 11, 10, 15, 7, 13, 10, 12, 9, 14]
ENDS = {2, 6, 9, 13}


def speech(pause, verse_pause):
    """Wave at 16 kHz, true starts, and the segments: 0.1 s a letter with pauses inside and at the end of verses."""
    r, x, starts, t = random.Random(7), [], [], 0.0
    quiet = lambda s: [r.uniform(-0.004, 0.004) for _ in range(int(s * 16000))]
    x += quiet(0.5)
    for i, n in enumerate(LETTERS):
        starts.append(len(x) / 16000)
        x += [r.uniform(-0.35, 0.35) for _ in range(int(n * 0.1 * 16000))]
        gap = verse_pause(i) if i in ENDS else pause
        x += quiet(gap if i < 13 else 0.6)
    del t
    return x, starts


@pytest.mark.parametrize(("pause", "verse_pause", "anchors", "tolerance"), [(0.0, lambda i: 0.5, 3, 0.4), (0.3, lambda i: 0.5, 3, 0.2), (0.0, lambda i: 0.05, 0, 3.0), (0.0, lambda i: 0.5 if i != 6 else 0.0, 2, 1.5)])
def test_timing_of_a_signal(spark, pause, verse_pause, anchors, tolerance):
    x, starts = speech(pause, verse_pause)
    frames = spark.createDataFrame([("r", x)], R + "x array<double>").select("rec_id", F.posexplode(signal.frame_db(F.col("x"), 160, 400)).alias("frame", "db"))
    pauses, bounds = signal.find_pauses(signal.speech_mask(frames, 6), 0.01, 0.22)
    seg = spark.createDataFrame([("r", i, n, i in ENDS) for i, n in enumerate(LETTERS)], R + "seg_ix int, letters int, verse_end boolean")
    got = signal.analyze(seg, pauses, bounds.withColumn("duration", F.lit(len(x) / 16000))).orderBy("seg_ix").collect()
    assert got[0]["anchors_total"] == 3 and got[0]["anchors_matched"] == anchors
    assert abs(got[0]["start"] - starts[0]) < 0.15
    times = [r["start"] for r in got]
    assert all(b > a for a, b in zip(times, times[1:]))
    inner = [abs(a - b) for a, b in zip(times, starts)]
    assert max(inner) < tolerance or sum(inner) / len(inner) < 0.35
    for i in (3, 7, 10):
        if verse_pause(i - 1) >= 0.5:
            assert abs(times[i] - starts[i]) < 0.15


def test_frames_of_long_recordings(spark):
    r = random.Random(9)
    x = [[r.uniform(-1, 1) for _ in range(500)] for _ in range(2)]
    d = spark.createDataFrame([("r", c, i, v) for c, ch in enumerate(x) for i, v in enumerate(ch)], R + "channel int, i int, x float")
    got = [row["db"] for row in signal.frame_db_rows(d, 40, 100).orderBy("frame").collect()]
    want = [20 * math.log10(math.sqrt(sum(ch[f * 40 + j] ** 2 for ch in x for j in range(100)) / 200) + 1e-8) for f in range(11)]
    assert len(got) == 11 and all(abs(a - b) < 1e-4 for a, b in zip(got, want))


def test_confidence(spark):
    cases = [((1.0, 0, 0.1, True, False), lambda c: c >= 0.95), ((1.0, 0, 0.1, True, True), lambda c: c <= 0.3), ((None, None, None, None, False), lambda c: 0.2 <= c <= 0.6), ((0.1, 60, 2.5, False, False), lambda c: c < 0.2)]
    d = spark.createDataFrame([(i, *x) for i, (x, _) in enumerate(cases)], "i int, s double, d int, g double, v boolean, p boolean")
    got = {r["i"]: r for r in d.select("i", quality.confidence(*map(F.col, "sdgvp")).alias("c"), quality.reasons(*map(F.col, "sdgvp")).alias("why")).collect()}
    assert all(ok(got[i]["c"]) for i, (_, ok) in enumerate(cases)) and got[0]["why"] == "—" and got[3]["why"].count("; ") == 3


def test_segment_tables(spark):
    s = spark.createDataFrame([("r", 0, 2, 1), ("r", 1, 1, 1), ("r", 2, 2, 2)], R + "seg_ix int, n_words int, verse int")
    ranges = quality.word_ranges(s)
    assert [(r["lo"], r["hi"]) for r in ranges.orderBy("seg_ix").collect()] == [(0, 1), (2, 2), (3, 4)]
    a = spark.createDataFrame([("r", 2)], R + "ref int")
    assert [r["anchor_dist"] for r in quality.anchor_distances(ranges, a).orderBy("seg_ix").collect()] == [1, 0, 1]
    assert [r["anchor_dist"] for r in quality.anchor_distances(ranges, a.limit(0)).orderBy("seg_ix").collect()] == [None] * 3
    assert [r["opens_verse"] for r in quality.verse_start_flags(s).orderBy("seg_ix").collect()] == [True, False, True]


def test_evaluation(spark):
    p = spark.createDataFrame([("m", i, e) for i, e in enumerate([-0.1, 0.3, 1.5, -0.05])], "method string, seg_ix int, start double")
    t = spark.createDataFrame([(i, 0.0) for i in range(4)], "seg_ix int, start double")
    m = quality.error_metrics(quality.boundary_errors(p, t)).first()
    assert (m["n"], m["early"], m["late"], m["pct_within_05"], m["pct_within_10"], m["median_abs"], m["max_abs"]) == (4, 0, 2, 75.0, 75.0, 0.3, 1.5)
    with pytest.raises(Exception, match="3 predicted boundaries against 4"):
        quality.boundary_errors(p.where("seg_ix < 3"), t).collect()
    e = spark.createDataFrame([("r", 0, 2, 10.0), ("r", 1, 8, 10.0)], R + "seg_ix int, letters int, duration double")
    assert [r["start"] for r in quality.equal_split(e).orderBy("seg_ix").collect()] == [0.0, 2.0]


def test_files(spark, tmp_path):
    for name, rate in (("a.wav", 16000), ("b.mp3", 0)):
        with open(tmp_path / name, "wb") as f:
            if rate:
                with wave.open(f, "wb") as w:
                    w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
                    w.writeframes((16384).to_bytes(2, "little", signed=True) * 10)
            else:
                f.write(b"x")
    (tmp_path / "c.txt").write_text("x")
    assert files.recordings(spark, str(tmp_path)).count() == 2 and files.newest_recording(spark, str(tmp_path)).first()["path"]
    s = files.read_waves(spark, str(tmp_path), 4).orderBy("chunk_ix").collect()
    assert [len(r["samples"]) for r in s] == [4, 4, 2] and s[0]["samples"][0] == 0.5
    lines = spark.createDataFrame([("# head",), ("    1.25  # x",), ("",), ("2.5",)], "value string")
    assert [r["start"] for r in files.truth_times(lines).collect()] == [1.25, 2.5]


def test_longest_increasing_against_the_definition():
    r = random.Random(4)
    for _ in range(300):
        ends = [r.randrange(8) for _ in range(r.randrange(12))]
        length, before = [], []
        for i, x in enumerate(ends):
            best = max((length[k] for k in range(i) if ends[k] < x), default=0)
            length.append(best + 1)
            before.append(next((k for k in range(i) if ends[k] < x and length[k] == best), -1) if best else -1)
        at, want = length.index(max(length)) if length else -1, []
        while at >= 0:
            want.append(at)
            at = before[at]
        assert align.longest_increasing(ends) == want[::-1]


def test_medians_of_many_values_without_gathering_them(spark):
    r = random.Random(5)
    values = {m: [r.choice([0.0, 0.25, r.random() * 10 ** r.randrange(-3, 4)]) * r.choice([-1, 1]) for _ in range(n)] for m, n in (("a", 1), ("b", 2), ("c", 501), ("d", 1000))}
    got = {x["method"]: x for x in quality.error_metrics(spark.createDataFrame([(m, v) for m, vs in values.items() for v in vs], "method string, error double")).collect()}
    for m, vs in values.items():
        ordered = sorted(map(abs, vs))
        assert (got[m]["n"], got[m]["median_abs"], got[m]["max_abs"]) == (len(vs), ordered[len(vs) // 2], ordered[-1])
