"""Language-model scoring by deleted interpolation of bigrams.

The probability of a token is a mixture of the bigram and unigram maximum-likelihood estimates and the uniform one over
the vocabulary; the mixture weights depend on the frequency bucket of the context (powers of two) and are learned by
expectation-maximisation on held-out counts: the tokens of the training documents of one fold, each with its own
occurrence deleted from the counts.

Counts cover all training documents. Texts are read once into chunks of bounded size, in which a token is an index into
the chunk's sorted distinct hashes. A chunk asks for the totals of its own distinct keys: it sends them, with its own
counts, as packed key ranges; every range is merged, and a chunk is told of the keys whose total differs from its own
count. So a frequent word costs one entry for each chunk, not for each occurrence, and nothing of the size of the
vocabulary is broadcast or gathered.

Defined results: null and empty texts have the end as their only token; repeated rows count as often as they occur and
give repeated output rows; without training documents every probability is that of an empty model (base_score from
c = N = V = 0, score from the uniform estimate over one token); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.llm.common import U64, Out, buckets_for, cut, from_planes, id_crc, mix, planes, rows_of, table, texts, tune, words, written

#: Bytes of text in a chunk (a longer document is a chunk of its own); folds of the split; the fold that tunes weights.
CHUNK, FOLDS, TEST_FOLD, TUNE_FOLD = 6 << 20, 10, 0, 1
ADD, BINS, STEP, ROUNDS = 0.1, 40, 0.05, 60
END = U64(xxhash.xxh64_intdigest(b" end "))
_CHUNK = "chunk long, tune boolean, ids binary, sizes binary, train binary, tokens binary, keys binary"
_CHUNK_ARROW = pa.schema([("chunk", pa.int64()), ("tune", pa.bool_()), *((x, pa.binary()) for x in ("ids", "sizes", "train", "tokens", "keys"))])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, serial = TaskContext.get().partitionId(), 0
    held: dict[bool, list] = {False: [], True: []}
    size = {False: 0, True: 0}

    def flush(tune: bool) -> pa.RecordBatch:
        nonlocal serial
        rows, held[tune], size[tune] = held[tune], [], 0
        hashes = np.concatenate([h for _, _, h in rows])
        keys, tokens = np.unique(hashes, return_inverse=True)
        out = Out(_CHUNK_ARROW)
        out.add((part << 32) + 2 * serial + tune, tune, np.array([r[0] for r in rows], np.int64).tobytes(), np.array([len(r[2]) for r in rows], np.int64).tobytes(), np.array([r[1] for r in rows], np.bool_).tobytes(), planes(tokens.astype(np.uint32)), planes(keys))
        serial += 1
        return out.take()

    for doc_id, text in rows_of(batches, "doc_id", "text"):
        fold = id_crc(doc_id) % FOLDS
        w = words(text)
        h = np.empty(len(w) + 1, U64)
        h[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, w), U64, len(w))
        h[-1] = END
        tune = fold == TUNE_FOLD
        held[tune].append((doc_id, fold != TEST_FOLD, h))
        size[tune] += len(text) + 64
        if size[tune] >= CHUNK:
            yield flush(tune)
    for tune in (False, True):
        if held[tune]:
            yield flush(tune)


class Chunk:
    """A chunk's tokens with their keys and its own training counts."""

    def __init__(self, sizes: bytes, train: bytes, tokens: bytes, keys: bytes):
        self.sizes, self.train = np.frombuffer(sizes, np.int64), np.frombuffer(train, np.bool_)
        self.tokens, self.keys = from_planes(tokens, np.uint32), from_planes(keys, U64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.trained = np.repeat(self.train, self.sizes)
        end = np.searchsorted(self.keys, END)
        # the context of a first token is the end of a text
        self.context = np.empty_like(self.tokens)
        self.context[1:] = self.tokens[:-1]
        self.context[self.begin] = end
        with np.errstate(over="ignore"):
            pair = mix(self.keys[self.context] * U64(0x9E3779B97F4A7C15) + self.keys[self.tokens])
        self.pairs, self.pair = np.unique(pair, return_inverse=True)
        self.own1 = np.bincount(self.tokens[self.trained], minlength=len(self.keys))
        self.own2 = np.bincount(self.pair[self.trained], minlength=len(self.pairs))


def _ask(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))
        for chunk, *rest in rows_of(batches, "chunk", "sizes", "train", "tokens", "keys"):
            c = Chunk(*rest)
            for order, (keys, own) in enumerate(((c.keys, c.own1), (c.pairs, c.own2))):
                full, edges = cut(keys, n)
                for b in full:
                    a, z = edges[b], edges[b + 1]
                    small = own[a:z].max() < 255
                    out.add(int(b) * 2 + order, chunk, planes(keys[a:z]), planes(own[a:z].astype(np.uint8 if small else np.uint32)))
                    if out.full():
                        yield out.take()
        yield out.take()

    return run


def _merge(key: tuple, group: pa.Table) -> pa.Table:
    """Totals of one key range: for each chunk the places (in its keys of the range) of those that differ from its own
    counts, with the totals; chunk -1 has the range's sums."""
    keys = [from_planes(k, U64) for k in group["keys"].to_pylist()]
    own = np.concatenate([from_planes(c, np.uint8 if len(c) == len(k) else np.uint32) for k, c in zip(keys, group["counts"].to_pylist(), strict=True)]).astype(np.int64)
    size = np.array([len(k) for k in keys], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    keys = np.concatenate(keys)
    by = np.argsort(keys, kind="stable")
    sorted_keys = keys[by]
    start = np.nonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))[0]
    sums = np.add.reduceat(own[by], start)
    total = np.empty(len(keys), np.int64)
    total[by] = np.repeat(sums, np.diff(np.append(start, len(keys))))
    rows = []
    for chunk, a, n in zip(group["chunk"].to_pylist(), begin.tolist(), size.tolist(), strict=True):
        at = np.nonzero(total[a : a + n] != own[a : a + n])[0]
        if len(at):
            t = total[a + at]
            rows.append((chunk, planes(at.astype(np.uint32)), planes(t.astype(np.uint32 if t.max() < 1 << 32 else np.int64))))
    rows.append((-1, b"", planes(np.array([sums.sum(), (sums > 0).sum()], np.int64))))
    return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([key[0].as_py()] * len(rows), pa.int64()), "at": pa.array([r[1] for r in rows], pa.binary()), "totals": pa.array([r[2] for r in rows], pa.binary())})


def _totals(keys: np.ndarray, own: np.ndarray, told: pa.Table, order: int, n_buckets: int) -> np.ndarray:
    total, edges = own.astype(np.int64), cut(keys, n_buckets)[1]
    for b, at, t in zip(told["bucket"].to_pylist(), told["at"].to_pylist(), told["totals"].to_pylist(), strict=True):
        if b % 2 == order:
            total[edges[b // 2] + from_planes(at, np.uint32)] = from_planes(t, np.uint32 if len(t) == len(at) else np.int64)
    return total


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(np.maximum(context, 0).astype(float))[1], BINS - 1)


def weights(hist: list[tuple[int, int, int, int]], v: int) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) for each context bucket by expectation-maximisation.

    hist: bucket, binned -log10 of the bigram and unigram estimates (-1: zero), tokens. A bucket without tokens, and
    every bucket to the amount of one token, leans on equal weights."""
    lam = np.full((BINS, 3), 1 / 3)
    if not hist:
        return lam
    h = np.array(hist, np.int64)
    p = np.stack([np.where(h[:, 1] < 0, 0.0, 10 ** (-STEP * h[:, 1])), np.where(h[:, 2] < 0, 0.0, 10 ** (-STEP * h[:, 2])), np.full(len(h), 1 / max(v + 1, 1))], axis=1)
    for _ in range(ROUNDS):
        share = lam[h[:, 0]] * p
        share *= (h[:, 3] / share.sum(axis=1))[:, None]
        new = np.full((BINS, 3), 1 / 3)
        np.add.at(new, h[:, 0], share)
        lam = new / new.sum(axis=1, keepdims=True)
    return lam


def _held_out(n: int, n_buckets: int):
    """The histogram of a tuning chunk's estimates, each token deleted from the counts it is estimated by."""

    def run(_: tuple, left: pa.Table, told: pa.Table) -> pa.Table:
        rows: list[np.ndarray] = []
        for args in zip(*(left[x].to_pylist() for x in ("sizes", "train", "tokens", "keys")), strict=True):
            c = Chunk(*args)
            one, two = _totals(c.keys, c.own1, told, 0, n_buckets), _totals(c.pairs, c.own2, told, 1, n_buckets)
            ctx = one[c.context] - 1
            with np.errstate(divide="ignore", invalid="ignore"):
                p2 = np.where(ctx > 0, (two[c.pair] - 1) / np.maximum(ctx, 1), 0.0)
                p1 = (one[c.tokens] - 1) / max(n - 1, 1)
                q = [np.where(p > 0, np.rint(-np.log10(p) / STEP), -1).astype(np.int64) for p in (p2, p1)]
            rows.append(np.stack([_bucket(ctx), *q], axis=1)[c.trained])
        every, count = np.unique(np.concatenate(rows), axis=0, return_counts=True) if rows else (np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
        return pa.table({"b": every[:, 0], "q2": every[:, 1], "q1": every[:, 2], "n": count.astype(np.int64)})

    return run


def _score(n: int, v: int, lam: np.ndarray, n_buckets: int):
    def run(_: tuple, left: pa.Table, told: pa.Table) -> pa.Table:
        cols: list[list] = [[] for _ in range(6)]
        for ids, *args in zip(*(left[x].to_pylist() for x in ("ids", "sizes", "train", "tokens", "keys")), strict=True):
            c = Chunk(*args)
            one, two = _totals(c.keys, c.own1, told, 0, n_buckets), _totals(c.pairs, c.own2, told, 1, n_buckets)
            base = np.log10((one + ADD) / (n + ADD * (v + 1)))[c.tokens]
            ctx, w = one[c.context], lam[_bucket(one)][c.context]
            p = w[:, 0] * two[c.pair] / np.maximum(ctx, 1) + w[:, 1] * one[c.tokens] / max(n, 1) + w[:, 2] / (v + 1)
            # a context that was never seen has no bigram estimate, an empty corpus no unigram one: their weight goes to the uniform one
            p += np.where(ctx > 0, 0.0, w[:, 0] / (v + 1)) + (w[:, 1] / (v + 1) if not n else 0.0)
            for k, x in enumerate((np.frombuffer(ids, np.int64), ~c.train, c.sizes, np.add.reduceat((one[c.tokens] > 0).astype(np.int64), c.begin), np.add.reduceat(base, c.begin), np.add.reduceat(np.log10(p), c.begin))):
                cols[k].append(x)
        kinds = (np.int64, np.bool_, np.int64, np.int64, np.float64, np.float64)
        a = [np.concatenate(x).astype(k) if x else np.zeros(0, k) for x, k in zip(cols, kinds, strict=True)]
        names = ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")
        return pa.table(dict(zip(names, a, strict=True))).append_column("train_tokens", pa.array(np.full(len(a[0]), n, np.int64)))

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score, train_tokens."""
    spark = docs.sparkSession
    chunks = written(texts(docs).mapInArrow(_encode, _CHUNK), "chunks")
    n_buckets = buckets_for(docs)
    asked = chunks.mapInArrow(_ask(n_buckets), "bucket long, chunk long, keys binary, counts binary")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a chunk is a batch of its own
    try:
        told = written(asked.groupBy("bucket").applyInArrow(_merge, "chunk long, bucket long, at binary, totals binary"), "totals")
    finally:
        tune(spark)
    sums = told.where("chunk = -1 AND bucket % 2 = 0").select("totals").toLocalIterator()
    n = v = 0
    for (raw,) in sums:  # two numbers for each key range
        a, b = from_planes(raw, np.int64)
        n, v = n + int(a), v + int(b)
    told = told.where("chunk >= 0")
    held = chunks.where("tune")
    hist = held.groupBy("chunk").cogroup(told.where("chunk % 2 = 1").groupBy("chunk")).applyInArrow(_held_out(n, n_buckets), "b long, q2 long, q1 long, n long")
    # the bins bound this table, whatever the corpus
    lam = weights([tuple(r) for r in hist.groupBy("b", "q2", "q1").agg(F.sum("n")).collect()], v)
    out = chunks.groupBy("chunk").cogroup(told.groupBy("chunk"))
    return out.applyInArrow(_score(n, v, lam, n_buckets), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, train_tokens long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
