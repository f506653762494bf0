"""Quality rules with cross-document line frequency.

Lines are normalised (words, A-Z lower-cased, single spaces) and hashed. For every host the distinct documents that hold a
line are counted; a line is over the limit if more than ``max(floor, share * documents of the host)`` hold it. ``cleaned``
removes such a line everywhere but in the document with the smallest id, so that no line is lost altogether; ``judge``
counts the words that this takes. A document is depleted, and rejected, when less than ``keep`` of its words or fewer than
``LEAST`` words are left.

Counting is done in two aggregations with partial sums (per document, then per line), so a hot host or line never meets in
one task.

Defined results: null text has no words (rejected as too short); null source and an empty one are the same host; texts are
read whole, whatever their length; repeated rows of one document count once for line frequency and give repeated output
rows, each judged by its own text; a line exactly at the limit stays; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.llm.common import LOWER, U64, Out, mix, rows_of, table, texts, written

FLOOR, SHARE, KEEP, LEAST = 3, 0.02, 0.5, 50
_SYMBOLS = bytes(set(range(256)) - set(b"#*$%&|<>"))


def _repeats(raw: list[bytes]) -> int:
    """Words covered by three-word windows that occur twice or more."""
    n = len(raw) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in raw), np.int64, len(raw))
    base = len(ids)
    if base < 2_000_000:
        key = (at[:-2] * base + at[1:-1]) * base + at[2:]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    else:
        pair = np.unique(at[:-1] * base + at[1:], return_inverse=True)[1]
        _, inverse, count = np.unique(pair[:-1] * base + at[2:], return_inverse=True, return_counts=True)
    hit = np.zeros(len(raw) + 1, np.int64)
    starts = np.nonzero(count[inverse] > 1)[0]
    np.add.at(hit, starts, 1)
    np.add.at(hit, starts + 3 if len(starts) else starts, -1)
    return int((np.cumsum(hit)[:-1] > 0).sum())


def measure(text: str) -> tuple[int, int, int, int, int, bytes, bytes]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, hashes and word counts of the distinct lines."""
    raw = text.encode("utf-8", "replace")
    seen: set[bytes] = set()
    found: dict[int, int] = {}
    dup, all_words = 0, []
    for line in raw.split(b"\n"):
        w = line.split()
        if not w:
            continue
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        all_words += w
        h = xxhash.xxh64_intdigest(b" ".join(w).translate(LOWER))
        found[h] = found.get(h, 0) + len(w)
    inner = b"".join(all_words)
    chars = len(inner.decode("utf-8"))
    symbols = len(raw.translate(None, _SYMBOLS))
    return len(all_words), chars, symbols, dup, _repeats(all_words), np.fromiter(found.keys(), U64, len(found)).tobytes(), np.fromiter(found.values(), np.int32, len(found)).tobytes()


_SCHEMA = "doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("doc_id", pa.int64()), ("host", pa.string()), ("text_hash", pa.int64())] + [(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    out = Out(pa.schema([*kinds, ("lines", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int32()))]), rows=2000)
    for doc_id, text, host in rows_of(batches, "doc_id", "text", "host"):
        *numbers, lines, counts = measure(text)
        h = np.array([xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))], U64).view(np.int64)[0]
        out.add(doc_id, host, int(h), *numbers, np.frombuffer(lines, np.int64), np.frombuffer(counts, np.int32))
        if out.full():
            yield out.take()
    yield out.take()


def _judged(docs: DataFrame, host: str, floor: int, share: float, keep: float) -> tuple[DataFrame, DataFrame]:
    named = texts(docs, F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))
    m = written(named.mapInArrow(_measured, _SCHEMA), "quality")
    lines = m.select("doc_id", "host", "text_hash", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("doc_id", "host", "text_hash", F.col("x.lines").alias("line"), F.col("x.line_words").alias("k"))
    per_line = lines.select("host", "line", "doc_id").distinct().groupBy("host", "line").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where(F.col("n") > floor)
    hosts = m.select("host", "doc_id").distinct().groupBy("host").agg(F.count("*").alias("of"))
    over = per_line.join(hosts, "host").where(F.col("n") > share * F.col("of")).select("host", "line", "first")
    over = lines.join(over, ["host", "line"]).where("doc_id != first")
    hit = over.select("doc_id", "text_hash", "line", "k").distinct()
    lost = hit.groupBy("doc_id", "text_hash").agg(F.sum("k").alias("removed_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = m.drop("lines", "line_words").join(lost, ["doc_id", "text_hash"], "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("removed_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (left >= LEAST) & (left >= keep * F.col("n_words"))), over


def judge(docs: DataFrame, host: str = "source", floor: int = FLOOR, share: float = SHARE, keep: float = KEEP) -> DataFrame:
    """doc_id, the base counts, removed_words (of lines over the limit), base_failed and kept."""
    return _judged(docs, host, floor, share, keep)[0]


def without(text: str, lines: set[int]) -> str:
    """The text without the lines whose signed hashes are in ``lines``; all others stay as they are."""
    held = []
    for line in text.encode("utf-8", "replace").split(b"\n"):
        w = line.split()
        h = xxhash.xxh64_intdigest(b" ".join(w).translate(LOWER)) if w else 0
        if not w or (h - (1 << 64) if h >= 1 << 63 else h) not in lines:
            held.append(line)
    return b"\n".join(held).decode("utf-8")


def cleaned(docs: DataFrame, host: str = "source", floor: int = FLOOR, share: float = SHARE, keep: float = KEEP) -> DataFrame:
    """The rows of the documents of which every text is kept, in the columns of ``docs``, their texts without the lines
    over the limit; n_chars, where there is one, follows a text that changed."""
    judged, over = _judged(docs, host, floor, share, keep)
    rejected = judged.where(~F.col("kept")).select("doc_id").distinct()
    lines = over.groupBy("doc_id", "host").agg(F.collect_set("line").alias("lines")).select(F.col("doc_id").alias("_doc"), F.col("host").alias("_host"), F.col("lines").alias("_lines"))

    @F.udf("string", useArrow=True)
    def clean(text, gone):
        return text if text is None or gone is None else without(text, set(gone))

    rest = docs.where(F.col("doc_id").isNotNull()).join(rejected, "doc_id", "left_anti")
    rest = rest.join(lines, (F.col("doc_id").cast("long") == F.col("_doc")) & (F.coalesce(F.col(host).cast("string"), F.lit("")) == F.col("_host")), "left")
    rest = rest.withColumn("text", clean("text", "_lines"))
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.when(F.col("_lines").isNotNull() & F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rest.select(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


#: op9 in DuckDB's SQL; lines stand for their hashes.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT doc_id, text, host, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri) WHERE c > 1) GROUP BY doc_id),
raw AS (SELECT doc_id, host, text, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d)),
lines AS (SELECT doc_id, host, text, line, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm, len(lw) AS k FROM raw WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
often AS (SELECT host, norm, min(doc_id) AS first FROM lines JOIN (SELECT host, count(DISTINCT doc_id) AS of_ FROM d GROUP BY host) USING (host) GROUP BY host, norm, of_ HAVING count(DISTINCT doc_id) > 3 AND count(DISTINCT doc_id) > 0.02 * of_),
lost AS (SELECT l.doc_id, sum(k) AS n FROM lines l JOIN often o ON l.host = o.host AND l.norm = o.norm WHERE l.doc_id <> o.first GROUP BY l.doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS removed_words FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN hit USING (doc_id) LEFT JOIN lost USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - removed_words >= 50 AND n_words - removed_words >= 0.5 * n_words AS kept, removed_words FROM b
"""
