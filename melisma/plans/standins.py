"""Deterministic stand-ins for verses, recordings and requests, derived from the driver's tables.

The tables hold no pointed Hebrew and no audio. Sentences of ``documents`` become verses by mapping letters (consonants to
letters, vowels to points, some signs to accents), and ``events`` of a user become a recording: their order, kinds and
times stand for words, onsets and boundaries. Each function has an SQL twin in ``CTE``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from melisma.functions import text as T

FROM = "bcdfghjklmnpqrstvwxyzaeiou,!-éèüäñó"
# Points follow the letters in the order of the vowels; accents stand for the signs.
TO = "בגדהוזחטיכלמנסעפצקרשת" + "ִֶַֹֻ" + "֑֔־" + "֖֥֭֙֗֡"
assert len(FROM) == len(TO)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a text table for each core below which it is dealt out anew: a small file of one row group is one task.
SMALL = 16 << 20


def read_texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose texts are long work for a row; a small one is spread over the cores first, a large one is so already."""
    df = read(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, s (from 1), raw: sentences in lower case."""
    return read_texts(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.lower("text"), r"\.")).alias("s", "raw")).select("doc_id", (F.col("s") + 1).alias("s"), "raw")


def hebrew(raw: Column) -> Column:
    return F.translate(F.regexp_replace(raw, "the ", "the-"), FROM, TO)


def verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, s, text: sentences with letters, in Hebrew, each with the mark that ends a verse."""
    return sentences(spark, sf_dir).where(F.col("raw").rlike("[a-z]")).select("doc_id", "s", F.concat(hebrew(F.col("raw")), F.lit(T.SOF_PASUQ)).alias("text"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, s, i (from 0), word."""
    w = verses(spark, sf_dir).select("doc_id", "s", F.posexplode_outer(T.tokens(T.clean_text(F.col("text")))).alias("i", "word"))
    return w.where("i IS NOT NULL")  # not posexplode: the filter inferred for it would clean every text twice


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, k, event_id, event_type, t: a user's events in order, in thousands of seconds from the first."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events")
    first = F.min(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("user_id"))
    return e.select(F.col("user_id").alias("rec_id"), (F.row_number().over(w) - 1).cast("int").alias("k"), "event_id", "event_type", "value", ((F.unix_micros(F.col("ts").cast("timestamp")) - first) / 1e9).alias("t"))


CTE = {
    "sent": ("", "SELECT doc_id, CAST(s AS INT) AS s, raw FROM (SELECT doc_id, unnest(string_split(lower(text), '.')) AS raw, generate_subscripts(string_split(lower(text), '.'), 1) AS s FROM documents)"),
    "verse": ("sent", f"SELECT doc_id, s, translate(replace(raw, 'the ', 'the-'), '{FROM}', '{TO}') || '{T.SOF_PASUQ}' AS text FROM sent WHERE regexp_matches(raw, '[a-z]')"),
    "clean": ("verse", r"SELECT doc_id, s, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) AS text FROM verse"),
    "listed": ("clean", f"SELECT doc_id, s, list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '{T.LETTERS}')) AS ws FROM clean"),
    "word": ("listed", "SELECT doc_id, s, CAST(unnest(range(len(ws))) AS INT) AS i, unnest(ws) AS word FROM listed"),
    "rec": ("", "SELECT user_id AS rec_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS k, event_id, event_type, value, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e9 AS t FROM events"),
}


def with_(name: str, select: str, more: dict[str, str] | None = None, recursive: bool = False) -> str:
    """An SQL text whose stand-in ``name``, with all it builds on, precedes ``select`` (and further tables)."""
    chain: list[str] = []
    for part in name.split("+"):
        at, own = part, []
        while at:
            own.append(at)
            at = CTE[at][0]
        chain += [x for x in reversed(own) if x not in chain]
    parts = [f"{x} AS ({CTE[x][1]})" for x in chain] + [f"{k} AS ({v})" for k, v in (more or {}).items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {select}"
