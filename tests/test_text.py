"""Text functions, segmentation and requests on small literal cases."""

import pytest
from pyspark.sql import functions as F

from melisma import dims
from melisma.functions import text as T
from melisma.operators import requests, segment

PROSE = "בְּרֵאשִׁ֖ית בָּרָ֣א אֱלֹהִ֑ים אֵ֥ת הַשָּׁמַ֖יִם וְאֵ֥ת הָאָֽרֶץ׃"
POETIC = "בִּנְא֣וֹת דֶּ֭שֶׁא יַרְבִּיצֵ֑נִי עַל־מֵ֖י מְנֻח֣וֹת יְנַהֲלֵֽנִי׃"
KETIV = "וְקָרְב֣וּ (ידו) יָדָ֔יו אֶל־הָעָֽם׃"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("א&nbsp;<b>ב</b> {פ}<br/>ג", "א ב ג"),
        ("<big>בְּ</big>רֵאשִׁ֖ית", "בְּרֵאשִׁ֖ית"),
        ('א<sup>1</sup><i class="footnote">note <b>x</b></i>ב', "א ב"),
        ("&lt;b&gt;א", "<b>א"),
        ("  א‏ (ס) ב   ג\n", "א ב ג"),
        ("<I CLASS='x'>א</I>", "א"),
        ("", ""),
        (None, None),
    ],
)
def test_cleaning(spark, raw, clean):
    assert one(spark, raw, T.clean_text) == clean


def test_references_without_a_semicolon(spark):
    raw = "א&amp;&amp</h1><p>p &quo &copy; &am<b>p{</b> &notit; &#1489; &lt;i&gt;"
    assert one(spark, raw, lambda x: T.clean_text(x, closed=True)) == "א&&ampp &quo © &amp{ &notit; ב <i>"
    assert one(spark, raw, T.clean_text) == "א&&p &quo © &{ ¬it; ב <i>"


def test_tokens_need_letters(spark):
    assert one(spark, "א ׀ ב־ג x", T.tokens) == ["א", "ב־ג"]


def test_accents_and_ranks(spark):
    assert one(spark, "א֖אֽ֖", T.word_accents) == ["֖"]
    w = "א֖"
    assert one(spark, w, T.word_rank) == 2 and one(spark, w, lambda x: T.word_rank(x, True)) is None
    assert one(spark, "א׃", T.word_rank) == 1 and one(spark, "א֑", lambda x: T.word_rank(x, True)) == 2 and one(spark, "א֣", T.word_rank) is None


def test_spoken_forms(spark):
    assert one(spark, "(ידו)", T.is_ketiv) and not one(spark, "יָד", T.is_ketiv) and not one(spark, "׀", T.is_ketiv)
    assert one(spark, "אֶל־הָעָֽם׃", lambda x: T.spoken_words(x, False)) == ["אל", "העם"]
    assert one(spark, "אֶל־הָעָֽם׃", lambda x: T.spoken_words(x, True)) == ["אֶל", "הָעָם"]
    assert one(spark, "יְהוָ֑ה", lambda x: T.spoken_words(x, False)) == ["אדני"] and one(spark, "לַיהוָ֔ה", lambda x: T.spoken_words(x, False)) == ["ליהוה"]
    assert one(spark, "אדוני", T.normalize_word) == "אדני" and one(spark, "מֶלֶךְ!", T.normalize_word) == "מלכ"


def test_clocks(spark):
    d = spark.createDataFrame([(3661.5,), (-1.0,), (0.0005,), (0.0015,)], "x double").select(T.srt_time(F.col("x")).alias("y"), T.clock(F.abs("x")).alias("c")).collect()
    assert [r["y"] for r in d] == ["01:01:01,500", "00:00:00,000", "00:00:00,000", "00:00:00,002"] and d[0]["c"] == "[61:01]"


def test_upper_median(spark):
    d = spark.createDataFrame([([4.0, 1.0, 3.0, 2.0],), ([],), ([7.0],)], "v array<double>").select(T.upper_median(F.col("v")).alias("m")).collect()
    assert [r["m"] for r in d] == [3.0, None, 7.0]


@pytest.mark.parametrize(
    ("ranks", "sizes"),
    [
        ([2, None, 1, None, 2, None, None], [3, 4]),
        ([None, None, None, None, 2], [2, 3]),
        ([None, 2, None, 2, None, None], [4, 2]),
        ([None] * 6, [3, 3]),
        ([None, 2, None, None, 1, None, 2, None, None], [2, 3, 4]),
        ([None, 2, 2, None, None], [3, 2]),
        ([1], [1]),
        ([], []),
    ],
)
def test_cuts(ranks, sizes):
    got = segment.cut_ranges(ranks, 4)
    assert [b - a + 1 for a, b in got] == sizes
    assert [i for a, b in got for i in range(a, b + 1)] == list(range(len(ranks)))


def test_cuts_against_a_scan():
    import random

    def scan(ranks, lo, hi, most):
        n = hi - lo + 1
        if n <= most:
            return [(lo, hi)]
        found = [(ranks[i], abs((i - lo) - (n - 1) / 2), i) for i in range(lo, hi) if ranks[i] is not None]
        at = min(found)[2] if found else lo + n // 2 - 1
        return scan(ranks, lo, at, most) + scan(ranks, at + 1, hi, most)

    r = random.Random(1)
    for _ in range(500):
        ranks = [r.choice([None, None, 1, 2, 3, 4]) for _ in range(r.randrange(1, 40))]
        most = r.randrange(1, 6)
        assert segment.cut_ranges(ranks, most) == scan(ranks, 0, len(ranks) - 1, most)


def test_joining_silent_ranges():
    r = [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert segment.join_silent(r, [False, True, False, True]) == [(0, 1 + 1), (3, 3)]
    assert segment.join_silent(r, [False] * 4) == [] and segment.join_silent([], []) == [] and segment.join_silent(r, [True] * 4) == r
    assert segment.join_silent(r, [False, False, True, False]) == [(0, 3)]


def verse_segments(spark, text, most=4):
    v = spark.createDataFrame([(1, text)], "v int, text string")
    return [r.asDict() for r in segment.segments_for_pipeline(v, ["v"], most).orderBy("seg_ix").collect()]


def test_verses(spark):
    s = verse_segments(spark, PROSE)
    assert len(s) == 2 and s[0]["display"].endswith("אֱלֹהִ֑ים") and len(s[1]["display"].split()) == 4 and s[1]["display"].endswith("׃")
    assert len(verse_segments(spark, POETIC, 3)[0]["display"].split()) == 3
    k = verse_segments(spark, KETIV, 8)
    assert "(ידו)" in k[0]["display"] and k[0]["align_plain"] == ["וקרבו", "ידיו", "אל", "העם"] and len(k[0]["align_vocalized"]) == 4
    silent = verse_segments(spark, "יָדָ֥יו (ידו) חָזָֽק׃", 1)
    assert [x["display"] for x in silent] == ["יָדָ֥יו (ידו)", "חָזָֽק׃"]
    assert verse_segments(spark, "(ידו) (ידו)", 1) == [] and verse_segments(spark, "", 4) == []
    lead = verse_segments(spark, "(ידו) חָזָֽק׃", 1)
    assert [x["display"] for x in lead] == ["(ידו) חָזָֽק׃"]


def test_custom_sizes(spark):
    v = spark.createDataFrame([("r", 1, "אָ בָ גָ"), ("r", 2, "דָ הָ וָ זָ")], "rec string, verse int, text string")
    sizes = lambda *n: spark.createDataFrame([("r", i, x) for i, x in enumerate(n)], "rec string, seg_ix int, size int")
    got = segment.verses_to_segments(v, ["rec"], splits=sizes(2, 3, 2)).orderBy("seg_ix").collect()
    assert [(r["display"], r["verse"]) for r in got] == [("אָ בָ", 1), ("גָ דָ הָ", 1), ("וָ זָ", 2)]
    for bad in ((3, 3), (7, 0), (8,)):
        with pytest.raises(Exception, match="sizes cover|a word at least"):
            segment.verses_to_segments(v, ["rec"], splits=sizes(*bad)).collect()


def test_payload(spark):
    v = spark.createDataFrame([("r", 1, PROSE), ("r", 2, KETIV)], "rec string, verse int, text string")
    s = segment.segments_for_pipeline(v, ["rec", "verse"])
    got = segment.payload_segments(s, ["rec"], 5).orderBy("verse", "seg_ix").collect()
    assert [r["verse"] for r in got] == [5, 5, 6] and [r["verse_end"] for r in got] == [False, True, True] and got[0]["words"] == 3 and got[0]["letters"] == 14


def test_books(spark):
    assert dims.books(spark).count() == 39 and dims.book_names(spark).count() == 39 + 7 + 39
    assert one(spark, " תהילים ", requests.to_english) == "Psalms" and one(spark, "Foo ", requests.to_english) == "Foo" and one(spark, None, requests.to_english) == ""
    assert one(spark, "Genesis", requests.is_known) and not one(spark, "Foo", requests.is_known)
    got = requests.book_titles(spark.createDataFrame([("רות",)], "book string")).first()
    assert (got["section"], got["ord"]) == ("ketuvim", 30)


def test_references(spark):
    rows = [("B", 1, None, None, None, "B 1"), ("B", 1, 2, None, None, "B 1:2"), ("B", 1, 2, None, 5, "B 1:2-5"), ("B", 1, 2, 3, 4, "B 1:2-3:4"), ("B", 1, 2, 3, None, "B 1:2-3:1"), ("B", 1, 2, 1, 4, "B 1:2-4"), ("B", 1, None, 3, 4, "B 1")]
    d = spark.createDataFrame(rows, "b string, c int, v int, e int, w int, want string")
    assert all(r["got"] == r["want"] for r in d.select("want", requests.build_ref(*map(F.col, "bcvew")).alias("got")).collect())


@pytest.mark.parametrize(("raw", "ok"), [("[1,2]", True), (" ", True), ("[20000]", True), ("[20001]", False), *[(x, False) for x in ("x", "[]", "{}", "[0]", "[-1]", '["3"]', "[1.5]", "[true]", "[01]", "[1,]")]])
def test_splits(spark, raw, ok):
    r = spark.createDataFrame([(raw,)], "x string").select(*[c.alias(n) for c, n in zip(requests.parse_splits(F.col("x")), ("s", "e"), strict=True)]).first()
    assert (r["e"] is None) == ok and (r["s"] is not None) == (ok and bool(raw.strip()))


def test_parameters(spark):
    base = {"book": "Genesis", "chapter": "2", "verse_start": "3", "verse_end": "9", "chapter_end": "", "max_words": "", "splits": ""}
    cases = [({}, None), ({"book": ""}, "book: missing"), ({"book": "X"}, "book: unknown"), ({"chapter": "0"}, "chapter: missing"), ({"chapter": "x"}, "chapter: not a number"), ({"verse_end": "1"}, "verse_end: before verse_start"), ({"verse_end": "1", "chapter_end": "2"}, None), ({"chapter_end": "1"}, "chapter_end: before chapter"), ({"max_words": "11"}, "max_words: out of range"), ({"splits": "[0]"}, "splits: empty segment")]
    d = spark.createDataFrame([(i, *(base | x).values()) for i, (x, _) in enumerate(cases)], "i int, " + ", ".join(f"{k} string" for k in base))
    got = {r["i"]: r for r in requests.parse_params(d, ["i"]).collect()}
    assert [got[i]["error"] for i in range(len(cases))] == [e for _, e in cases] and got[0]["max_words"] == 4


def test_query_fields_and_uploads(spark):
    d = spark.createDataFrame([("",), ("0",), ("-1",), ("7 ",), ("x",)], "x string")
    value, error = requests.read_int(F.col("x"), required=True)
    assert [(r[0], r[1]) for r in d.select(value, error).collect()] == [(None, "missing"), (None, "below one"), (None, "below one"), (7, None), (None, "not a number")]
    u = spark.createDataFrame([(0, "a.mp3"), (1, "b"), (400 * 2**20, "c.x/../y")], "n long, f string")
    status, suffix = requests.check_upload(F.col("n"), F.col("f"))
    assert [tuple(r) for r in u.select(status, suffix).collect()] == [(400, ".mp3"), (200, ".m4a"), (413, ".m4a")]
    n = spark.createDataFrame([(None,), (1,), (9,), (5,)], "n int").select(requests.api_max_words(F.col("n")).alias("m")).collect()
    assert [r["m"] for r in n] == [4, 2, 8, 5]


def test_versions_and_pushes(spark):
    v = spark.createDataFrame([("a", 0, "he", "Plain"), ("a", 1, "he", "With Ta'amei Hamikra"), ("a", 2, "he", "By the MASORAH"), ("a", 3, "en", "Masorah"), ("b", 0, "en", "Masorah")], "book string, pos int, language string, version_title string")
    assert {r["book"]: r["version"] for r in requests.pick_version(v).collect()} == {"a": "By the MASORAH", "b": None}
    raw = ['{"endpoint":"https://x","keys":{"p256dh":"a","auth":"b"}}', '{"endpoint":"http://x","keys":{"p256dh":"a","auth":"b"}}', "no", None]
    got = spark.createDataFrame([(x,) for x in raw], "x string").select(requests.parse_push(F.col("x")).alias("p")).collect()
    assert [r["p"] is not None for r in got] == [True, False, False, False]
    t = spark.createDataFrame([("r", 0, "a"), ("r", 1, " "), ("r", 2, "b")], "rec string, i int, text string")
    assert [(r["verse"], r["text"]) for r in requests.number_verses(t, "rec", "i").orderBy("verse").collect()] == [(1, "a"), (2, "b")]


def test_numbers_round_by_their_binary_value(spark):
    d = spark.createDataFrame([(2.25,), (0.125,), (0.6125,), (2.675,), (-0.5,), (None,), (float("nan"),)], "x double")
    got = d.select(T.fixed(F.col("x"), 1), T.fixed(F.col("x"), 2, 8), T.rounded(F.col("x"), 3)).collect()
    assert [tuple(r) for r in got[:5]] == [(f"{x:.1f}", f"{x:8.2f}", round(x, 3)) for x in (2.25, 0.125, 0.6125, 2.675, -0.5)]
    assert [tuple(r) for r in got[5:]] == [(None, None, None)] * 2


def test_fields_are_trimmed_of_all_white_space(spark):
    d = spark.createDataFrame([("\t Genesis ", "\n7 ", "\t[1, 2]\n"), ("x", "1_0", " ")], "b string, n string, s string")
    got = d.select(requests.to_english(F.col("b")).alias("b"), requests.is_known(F.col("b")).alias("k"), requests.read_int(F.col("n"))[0].alias("n"), requests.int_or_none(F.col("n"))[0].alias("m"), requests.parse_splits(F.col("s"))[0].alias("s"), requests.parse_splits(F.col("s"))[1].alias("e")).collect()
    assert tuple(got[0]) == ("Genesis", True, 7, 7, [1, 2], None)
    assert tuple(got[1]) == ("x", False, 10, 10, None, None)
