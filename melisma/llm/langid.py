"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, runs of white space become one space, and n-grams of one to three characters are hashed into
``FEATURES`` slots. Document frequencies come from all training documents. The regression is trained by follow the
regularised leader with elastic-net penalties on a bounded sample (``PER_LANG`` documents of each language, those with
the smallest hashes of their id, and ``MAX_DOCS`` in all); every fifth of these is set aside to calibrate a temperature by their log loss. The
model (slots x languages) is bounded and sent to all tasks; prediction reads each text whole.

Only text and lang of documents whose ``crc32(doc_id as text) mod 3`` is not 1 are learned from. Lang, source and id are
no inputs of a prediction; the id only says which documents are held out.

Defined results: null text, and text without letters, is ``und`` with score 0; if there is nothing to learn from, every
document is ``und``; repeated rows give repeated output rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from melisma.llm.common import U64, Out, id_crc_column, rows_of, table, tune

BITS, ORDERS, PER_LANG, MAX_LANGS, MAX_DOCS = 14, (1, 2, 3), 400, 200, 8000
FEATURES = 1 << BITS
EPOCHS, ALPHA, BETA, L1, L2, SEED = 3, 0.3, 1.0, 0.05, 0.02, 7
BLOCK = 1 << 16


def counts(text: str) -> np.ndarray:
    """Occurrences of each slot in a whole text, a block of characters at a time."""
    line = " " + " ".join(text.lower().split()) + " "
    out = np.zeros(FEATURES, np.int64)
    top = max(ORDERS)
    for p in range(0, len(line), BLOCK):
        part = line[p : p + BLOCK + top - 1]
        c = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32).astype(U64)
        with np.errstate(over="ignore"):
            h = np.zeros(len(c), U64)
            for k in range(1, top + 1):
                n = min(len(c) - k + 1, BLOCK)
                if n <= 0:
                    break
                h = h[: len(c) - k + 1] * U64(0x100000001B3) + c[k - 1 :]
                if k in ORDERS:
                    slot = (h[:n] * U64(0x9E3779B97F4A7C15)) >> U64(64 - BITS)
                    out += np.bincount(slot.astype(np.int64), minlength=FEATURES)
    return out


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of the text's TF-IDF vector of length one."""
    n = counts(text)
    at = np.nonzero(n)[0]
    v = (1 + np.log(n[at])) * idf[at]
    return at, v / max(np.linalg.norm(v), 1e-12)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(FEATURES, np.int64), 0
    for (text,) in rows_of(batches, "text"):
        total += counts(text) > 0
        n += 1
    at = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["slot", "n"])


class Model:
    """Weights for each slot and language, inverse document frequencies and the temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.temperature = langs, idf, weights, temperature

    def logits(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        p = softmax(self.logits(*vector(text, self.idf)) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int) -> np.ndarray:
    """FTRL-proximal with elastic net; the last row of the weights is the bias."""
    z, n = np.zeros((FEATURES + 1, n_langs)), np.zeros((FEATURES + 1, n_langs))

    def current(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * L1 - z[at]
        return np.where(np.abs(z[at]) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    random = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            at, v, y = rows[i]
            at, v = np.append(at, FEATURES), np.append(v, 1.0)
            w = current(at)
            p = softmax(v @ w)
            p[y] -= 1
            g = v[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return current(np.arange(FEATURES + 1))


def learn(docs: DataFrame) -> Model:
    """Document frequencies over all rows of ``text`` and ``lang``; weights from the bounded sample of them."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    freq = dict(rows.select("text").mapInArrow(_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect())  # at most FEATURES + 1 rows
    total = freq.pop(-1, 0)
    df = np.zeros(FEATURES)
    df[np.array(list(freq), np.int64)] = list(freq.values())
    idf = np.log((1 + total) / (1 + df)) + 0.05
    spread = F.xxhash64("doc_id")
    langs = [r[0] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()]
    ranked = rows.select("doc_id", "lang", spread.alias("h")).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= min(PER_LANG, MAX_DOCS // max(1, len(langs))))
    ids = {r[0] for r in ranked.where(F.col("lang").isin(langs)).select("doc_id").collect()} if langs else set()
    index = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(pa.schema([("h", pa.int64()), ("y", pa.int64()), ("at", pa.binary()), ("v", pa.binary())]), rows=500)
        for doc_id, text, lang in rows_of(batches, "doc_id", "text", "lang"):
            if doc_id in ids and lang in index and has_letter(text):
                at, v = vector(text, idf)
                out.add(doc_id, index[lang], at.astype(np.int32).tobytes(), v.astype(np.float32).tobytes())
                if out.full():
                    yield out.take()
        yield out.take()

    got = rows.mapInArrow(run, "h long, y long, at binary, v binary").dropDuplicates(["h", "y"]).orderBy(F.xxhash64("h"), "h", "y").collect()
    data = [(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["v"], np.float32).astype(float), r["y"]) for r in got]
    if not data:
        return Model([], idf, np.zeros((FEATURES + 1, 0)), 1.0)
    held = data[::5] if len(data) >= 20 else data
    weights = follow_the_leader([d for i, d in enumerate(data) if i % 5 or len(data) < 20], len(langs))
    model = Model(langs, idf, weights, 1.0)
    z, y = np.array([model.logits(at, v) for at, v, _ in held]), np.array([k for *_, k in held])
    steps = np.exp(np.linspace(np.log(0.05), np.log(10), 160))
    model.temperature = float(min(steps, key=lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row that has an id."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x MAX_LANGS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())]))
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            out.add(doc_id, *shared.value.predict(text))
            if out.full():
                yield out.take()
        yield out.take()

    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tune(spark)
    held = id_crc_column() % 3 == 1
    model = learn(docs.where(F.col("doc_id").isNotNull() & ~held))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
