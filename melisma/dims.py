"""Small fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from melisma.functions.text import POETIC_RANKS, PROSE_RANKS

# Books by section, in order, in Hebrew and English.
SECTIONS = {
    "torah": (("בראשית", "Genesis"), ("שמות", "Exodus"), ("ויקרא", "Leviticus"), ("במדבר", "Numbers"), ("דברים", "Deuteronomy")),
    "neviim": (
        ("יהושע", "Joshua"), ("שופטים", "Judges"), ("שמואל א", "I Samuel"), ("שמואל ב", "II Samuel"), ("מלכים א", "I Kings"), ("מלכים ב", "II Kings"),
        ("ישעיהו", "Isaiah"), ("ירמיהו", "Jeremiah"), ("יחזקאל", "Ezekiel"), ("הושע", "Hosea"), ("יואל", "Joel"), ("עמוס", "Amos"), ("עובדיה", "Obadiah"),
        ("יונה", "Jonah"), ("מיכה", "Micah"), ("נחום", "Nahum"), ("חבקוק", "Habakkuk"), ("צפניה", "Zephaniah"), ("חגי", "Haggai"), ("זכריה", "Zechariah"), ("מלאכי", "Malachi"),
    ),
    "ketuvim": (
        ("תהלים", "Psalms"), ("משלי", "Proverbs"), ("איוב", "Job"), ("שיר השירים", "Song of Songs"), ("רות", "Ruth"), ("איכה", "Lamentations"), ("קהלת", "Ecclesiastes"),
        ("אסתר", "Esther"), ("דניאל", "Daniel"), ("עזרא", "Ezra"), ("נחמיה", "Nehemiah"), ("דברי הימים א", "I Chronicles"), ("דברי הימים ב", "II Chronicles"),
    ),
}
# Other spellings that are accepted.
ALIASES = {
    "תהילים": "Psalms", "ישעיה": "Isaiah", "ירמיה": "Jeremiah", "קוהלת": "Ecclesiastes", "שיר-השירים": "Song of Songs",
    "דברי-הימים א": "I Chronicles", "דברי-הימים ב": "II Chronicles",
}
BOOKS = [(he, en, section, i) for i, (section, he, en) in enumerate((s, he, en) for s, pairs in SECTIONS.items() for he, en in pairs)]
#: Every accepted name with its English title.
NAMES = {**{he: en for he, en, _, _ in BOOKS}, **ALIASES, **{en: en for _, en, _, _ in BOOKS}}


def books(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOOKS, "he string, en string, section string, ord int")


def book_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NAMES.items()), "name string, title string")


def accents(spark: SparkSession) -> DataFrame:
    rows = [(cp, system, rank) for system, ranks in (("prose", PROSE_RANKS), ("poetic", POETIC_RANKS)) for rank, cps in ranks.items() for cp in cps]
    return spark.createDataFrame(rows, "cp string, system string, rank int")
