"""Benchmark decontamination by latent semantic retrieval.

Texts are hashed to words once. Passages of ``PASSAGE`` words are TF-IDF vectors over hashed slots, without slots that
are in a large share of the passages. Document frequencies and the one product of the randomised singular value
decomposition (A^T A times a random test matrix; singular values and vectors follow from it by the Nystroem method) are
summed over all passages of all documents, as blocks of slots, so only matrices of fixed size come to the driver.

Sliding windows over the remaining words of every document are projected to the latent space and compared by cosine with
windows of the benchmark items (the stated query set); places of the least cosine of ``WINDOWS`` or more are candidates.
A window is projected only if half of its words or more are words of one group of items (a bit for each group, added up
over sliding windows by bitwise adders): below that no cosine is reached but by chance. A candidate is a leak if the
longest common subsequence of the item and the text around the place covers ``LCS`` of the item's words, or
``LCS_ANSWER`` of them and most of its answer (the words of its last sentence).

Defined results: null texts and items are empty and match nothing; texts are searched whole, in blocks of words that
overlap by a window; items with fewer than the shortest window's words are found by their exact words in order; equal
items each get their rows; of several places of an item in a document the one with the greatest share counts, of equals
that with the greater cosine, then the first; repeated rows of documents give repeated output rows; empty tables give no
rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.llm.common import Out, blobs, rows_of, size_of, table, texts, written

BITS, RANK, EXTRA, PASSAGE = 15, 64, 8, 24
SLOTS, SEED = 1 << BITS, 11
#: Least inverse document frequency of a slot that counts; passages by which frequencies are counted.
LEAST_IDF, FREQUENCY_PASSAGE = 2.3, 64
#: Sliding windows move by ``STRIDE`` words; their lengths with the least cosines; an item uses the longest that it
#: fills, from end to end.
STRIDE, WINDOWS = 4, {16: 0.5, 8: 0.5, 4: 0.7}
LCS, LCS_ANSWER, ANSWER = 0.7, 0.5, 0.7
BLOCK_WORDS, BLOCK_PAIRS, SLOT_BLOCK = 1 << 17, 1 << 21, 2048
#: Words that are gathered at once, so that their rows stay in the processor's cache.
GATHER = 1 << 14
#: Items for each word of group bits; the more items, the more bits.
ITEMS_A_PLANE = 256
#: Bytes of hashed words for each partial sum of the matrix product, so that small partitions do not multiply them.
PART = 16 << 20
#: Items beyond this number are searched in further passes, so the broadcast query block stays bounded.
ITEMS_AT_ONCE = 20_000

_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def hashed(text: str) -> np.ndarray:
    """32-bit hashes of the words in lower case, ASCII signs as spaces."""
    w = text.lower().encode("utf-8", "replace").translate(_PLAIN).split()
    return np.fromiter(map(xxhash.xxh32_intdigest, w), np.uint32, len(w))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Out(pa.schema([("doc_id", pa.int64()), ("w", pa.binary())]))
    for doc_id, text in rows_of(batches, "doc_id", "text"):
        out.add(doc_id, hashed(text).tobytes())
        if out.full():
            yield out.take()
    yield out.take()


def slots_of(w: np.ndarray) -> np.ndarray:
    return (w >> np.uint32(32 - BITS)).astype(np.uint16)


def _passages(batches: Iterator[pa.RecordBatch], size: int, idf: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Slots of words as rows of ``size``, the passages; the last one of a document ends in the empty slot ``SLOTS``."""
    held, n = [], 0
    for b in batches:
        for w in blobs(b.column("w"), np.uint32):
            for p in range(0, len(w), BLOCK_WORDS):
                s = slots_of(w[p : p + BLOCK_WORDS])
                s = s if idf is None else s[idf[s] > 0]
                if len(s):
                    held += [s, np.full(-len(s) % size, SLOTS, np.uint16)]
                    n += len(s)
            if n >= BLOCK_WORDS:
                yield np.concatenate(held).reshape(-1, size)
                held, n = [], 0
    if n:
        yield np.concatenate(held).reshape(-1, size)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(SLOTS + 1, np.int64), 0
    for rows in _passages(batches, FREQUENCY_PASSAGE):
        rows.sort(axis=1)
        new = np.ones(rows.shape, np.bool_)
        new[:, 1:] = rows[:, 1:] != rows[:, :-1]
        total += np.bincount(rows[new], minlength=SLOTS + 1)
        n += len(rows)
    at = np.nonzero(total[:SLOTS])[0]
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["slot", "n"])


def _sums(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the table's rows named by each row of slots."""
    out = np.empty((len(rows), table.shape[1]), np.float32)
    step = max(1, GATHER // rows.shape[1])
    held = np.empty((step * rows.shape[1], table.shape[1]), np.float32)
    for i in range(0, len(rows), step):
        part = rows[i : i + step]
        got = held[: part.size]
        np.take(table, part.ravel(), axis=0, out=got, mode="clip")
        got.reshape(len(part), rows.shape[1], -1).sum(axis=1, out=out[i : i + step])
    return out


def _range(idf: np.ndarray, test: np.ndarray):
    """Partial sums of A^T A times the test matrix, as blocks of slots; rows of A are passages scaled to length one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.append(idf, np.float32(0))
        weighted = np.concatenate([test * idf[:, None], np.zeros((1, test.shape[1]), np.float32)])
        square = weight**2
        y = np.zeros((test.shape[1], SLOTS + 1))
        for rows in _passages(batches, PASSAGE, idf):
            z = _sums(weighted, rows)
            z /= square[rows].sum(axis=1)[:, None]
            at = rows.ravel().astype(np.int64)
            for j, column in enumerate(np.ascontiguousarray(z.T, np.float64)):
                y[j] += np.bincount(at, weights=np.repeat(column, PASSAGE), minlength=SLOTS + 1)
        y = (y.T[:SLOTS] * idf[:, None]).astype(np.float32)
        for i in range(0, SLOTS, SLOT_BLOCK):
            part = y[i : i + SLOT_BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part.tobytes()], pa.binary())], names=["block", "part"])

    return run


def _summed(key: tuple, group: pa.Table) -> pa.Table:
    total = None
    for x in blobs(group["part"], np.float32):
        total = x.astype(np.float64) if total is None else total + x
    return pa.table({"block": pa.array([key[0].as_py()]), "of": pa.array([key[1].as_py()]), "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _sum_blocks(parts: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Sums by block of the parts of ``n`` partitions, in as many rounds as it takes for no task to add up over 64 of a block."""
    parts = parts.withColumn("of", F.spark_partition_id())
    while True:
        n = -(-n // 64)
        parts = parts.select("block", "part", F.floor(F.col("of") / 64).cast("long").alias("of")).groupBy("block", "of").applyInArrow(_summed, "block long, of long, part binary")
        if n <= 1:
            return {r["block"]: np.frombuffer(r["part"], np.float32) for r in parts.collect()}


class Space:
    """What projects slots to the latent space: singular vectors over singular values, times the frequencies' weights."""

    def __init__(self, idf: np.ndarray, vectors: np.ndarray, values: np.ndarray):
        self.idf = idf
        #: The last row is the empty slot's.
        self.projection = np.concatenate([(vectors / np.maximum(values, 1e-6) * idf[:, None]), np.zeros((1, vectors.shape[1]))]).astype(np.float32)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        """Latent vectors of length one of rows of slots."""
        x = _sums(self.projection, rows)
        return x / (np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] + 1e-6)


def decompose(tokens: DataFrame) -> Space:
    spark = tokens.sparkSession
    n_parts = max(spark.sparkContext.defaultParallelism, size_of(tokens) // PART)
    tokens = tokens.coalesce(n_parts)
    freq = dict(tokens.mapInArrow(_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect())  # SLOTS + 1 rows at most
    n = freq.pop(-1, 0)
    df = np.zeros(SLOTS)
    df[np.array(list(freq), np.int64)] = list(freq.values())
    idf = np.log((1.0 + n) / (1.0 + df)).astype(np.float32)
    idf[idf < min(LEAST_IDF, np.log(1.0 + n) / 2)] = 0  # among few passages a rare word is in a larger share of them
    test = np.random.default_rng(SEED).standard_normal((SLOTS, RANK + EXTRA), np.float32)
    y = np.zeros(test.shape)
    for i, part in _sum_blocks(tokens.mapInArrow(_range(idf, test), "block long, part binary"), n_parts).items():
        y[i : i + SLOT_BLOCK] = part.reshape(-1, RANK + EXTRA)
    shift = 1e-6 * np.linalg.norm(y) + 1e-9
    y += shift * test
    core = test.T.astype(float) @ y
    factor = np.linalg.cholesky((core + core.T) / 2 + 1e-9 * np.trace(core) / len(core) * np.eye(len(core)))
    vectors, values, _ = np.linalg.svd(np.linalg.solve(factor, y.T).T, full_matrices=False)
    return Space(idf, vectors[:, :RANK], np.maximum(values[:RANK], 1e-3 * max(values[0], 1e-9)))


class Items:
    """A block of benchmark items: their words and answers, query windows by length, and the group bits of the slots."""

    def __init__(self, rows: list[tuple[int, str]], space: Space):
        self.ids = [i for i, _ in rows]
        self.words = [hashed(t or "") for _, t in rows]
        self.sets = [frozenset(w.tolist()) for w in self.words]
        self.answers = [frozenset(hashed(answer(t or "")).tolist()) for _, t in rows]
        #: By length: the item, the first word and the latent vector of each query window, and the planes of group bits.
        self.queries: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.short: dict[int, list[int]] = {}
        found: dict[int, list] = {size: [] for size in WINDOWS}
        groups = -(-max(1, len(rows)) // ITEMS_A_PLANE) * 64
        bits = {size: np.zeros((groups // 64, SLOTS + 1), np.uint64) for size in WINDOWS}
        for k, w in enumerate(self.words):
            where = np.nonzero(space.idf[slots_of(w)] > 0)[0]
            size = next((s for s in WINDOWS if len(where) >= s), 0)
            if not size:
                if len(w):
                    self.short.setdefault(int(w[0]), []).append(k)
                continue
            bits[size][k % groups // 64, slots_of(w[where])] |= np.uint64(1 << (k % 64))
            # from end to end by steps of no whole number of strides, so that one of two neighbours is a word away from a
            # window of a copy at most; both phases at the ends
            last = len(where) - size
            for at in sorted({*range(0, last + 1, max(1, 3 * size // 8)), min(STRIDE // 2, last), max(0, last - STRIDE // 2), last, last // 2, min(last // 2 + STRIDE // 2, last)}):
                found[size].append((k, int(where[at]), slots_of(w[where[at : at + size]])))
        for size, q in found.items():
            if q:
                self.queries[size] = (np.array([k for k, *_ in q]), np.array([a for _, a, _ in q]), space.vectors(np.array([x for *_, x in q])), bits[size])


def answer(text: str) -> str:
    """The last sentence of an item."""
    parts = [s for s in re.split(r"[.!?\n]+", text) if s.strip()]
    return parts[-1] if parts else ""


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with a row of the table as the bits of one number."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        m = row & masks.get(y, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def check(items: Items, k: int, text: np.ndarray, first: int, last: int) -> tuple[float, bool]:
    """Share of the item's words in the longest common subsequence with the text around where it may begin (``first`` to
    ``last``), and whether it leaks."""
    item = items.words[k]
    slack = len(item) // 4 + 4
    around = text[max(0, first - slack) : last + len(item) + slack]
    # no subsequence is longer than the words in common
    words = around.tolist()
    if sum(map(items.sets[k].__contains__, words)) < LCS_ANSWER * len(item):
        return 0.0, False
    share = lcs_length(item, around) / len(item)
    if share >= LCS:
        return share, True
    wanted = items.answers[k]
    return share, share >= LCS_ANSWER and bool(wanted) and len(wanted.intersection(words)) >= ANSWER * len(wanted)


def _add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of numbers whose bits of equal worth stand in one array, for each bit of its elements alone."""
    out, carry = [], None
    for x, y in zip(a, b, strict=True):
        half = x ^ y
        if carry is None:
            out.append(half)
            carry = x & y
        else:
            out.append(half ^ carry)
            carry = (x & y) | (half & carry)
    return [*out, carry]


def _crowded(bits: np.ndarray, slots: np.ndarray) -> dict[int, np.ndarray]:
    """For windows of 4, 8 and 16 words at every ``STRIDE`` words, the groups that hold 3, 4 or 8 of their words or more."""
    m = [bits[x] for x in slots.reshape(-1, STRIDE).T]
    four = _add(_add([m[0]], [m[1]]), _add([m[2]], [m[3]]))
    eight = _add([x[:-1] for x in four], [x[1:] for x in four]) if len(four[0]) > 1 else [x[:0] for x in (*four, four[0])]
    sixteen = _add([x[:-2] for x in eight], [x[2:] for x in eight]) if len(eight[0]) > 2 else [x[:0] for x in (*eight, eight[0])]
    return {4: four[2] | (four[1] & four[0]), 8: eight[3] | eight[2], 16: sixteen[4] | sixteen[3]}


def candidates(texts: list[np.ndarray], items: Items, space: Space) -> Iterator[tuple[int, int, int, float]]:
    """Number of the text, item, place where it may begin, and cosine of all windows that are near a query window."""
    top = max(WINDOWS)
    # every text is followed by empty slots, so that no window meets the next one
    slots, place, number = [], [], []
    for i, w in enumerate(texts):
        where = np.nonzero(space.idf[slots_of(w)] > 0)[0]
        fill = top + -len(where) % STRIDE
        slots += [slots_of(w[where]), np.full(fill, SLOTS, np.uint16)]
        place += [where, np.full(fill, len(w))]
        number += [i] * ((len(where) + fill) // STRIDE)
    if not number:
        return
    slots, place, number = np.concatenate(slots), np.concatenate(place), np.array(number)
    for b in range(0, len(slots), BLOCK_WORDS):
        part = slots[b : b + BLOCK_WORDS + top]
        for size, (of, offset, z, bits) in items.queries.items():
            at = np.nonzero(np.bitwise_or.reduce([_crowded(x, part)[size] for x in bits])[: BLOCK_WORDS // STRIDE])[0] + b // STRIDE
            yield from _near(at, size, of, offset, z, slots, place, number, space)


def _near(at, size, of, offset, z, slots, place, number, space: Space) -> Iterator[tuple[int, int, int, float]]:
    """The windows at ``at`` (in strides) that are near a query window of this size."""
    step = max(1, BLOCK_PAIRS // len(of))
    for p in range(0, len(at), step):
        rows = at[p : p + step]
        cos = space.vectors(slots[rows[:, None] * STRIDE + np.arange(size)]) @ z.T
        row, col = np.nonzero(cos >= WINDOWS[size])
        begin = place[rows[row] * STRIDE] - offset[col]
        yield from zip(number[rows[row]].tolist(), of[col].tolist(), begin.tolist(), cos[row, col].tolist(), strict=True)


def search(texts: list[np.ndarray], items: Items, space: Space) -> Iterator[tuple[int, int, int, float, float]]:
    """Number of the text, number of the item, first word, cosine and share of its best leak, for each item that leaks into a text."""
    near: dict[tuple[int, int], list[tuple[int, float]]] = {}
    for i, k, begin, cos in candidates(texts, items, space):
        near.setdefault((i, k), []).append((max(0, begin), cos))
    if items.short:
        firsts = np.array(sorted(items.short), np.uint32)
        for i, w in enumerate(texts):
            p = np.minimum(np.searchsorted(firsts, w), len(firsts) - 1)
            for at in np.nonzero(firsts[p] == w)[0].tolist():
                for k in items.short[int(w[at])]:
                    item = items.words[k]
                    if len(w) - at >= len(item) and (w[at : at + len(item)] == item).all():
                        near.setdefault((i, k), []).append((at, 1.0))
    for (i, k), places in sorted(near.items()):
        places.sort()
        # neighbouring places are looked at together
        slack, best, p = len(items.words[k]) // 4 + 4, (0.0, 0.0, 0), 0
        while p < len(places) and best[0] < 1.0:
            q = p
            while q < len(places) and places[q][0] - places[p][0] <= slack:
                q += 1
            share, found = check(items, k, texts[i], places[p][0], places[q - 1][0])
            if found:
                cos, at = max(((c, -a) for a, c in places[p:q]))
                best = max(best, (share, cos, at))
            p = q
        if best[0]:
            yield i, k, -best[2], best[1], best[0]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, cosine, lcs_share for every item that leaks into a document."""
    tokens = written(texts(docs).mapInArrow(_tokens, "doc_id long, w binary"), "words")
    space = decompose(tokens)
    spark = docs.sparkSession
    queries = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    bounds = [None]
    n = queries.count()
    if n > ITEMS_AT_ONCE:  # further blocks of items by quantiles of their ids
        bounds += queries.approxQuantile("item_id", [ITEMS_AT_ONCE * i / n for i in range(1, -(-n // ITEMS_AT_ONCE))], 0.001)
    bounds.append(None)
    out = None
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        block = queries if lo is None else queries.where(F.col("item_id") >= lo)
        block = block if hi is None else block.where(F.col("item_id") < hi)
        rows = [(r["item_id"], r["text"]) for r in block.orderBy("item_id").collect()]
        shared = spark.sparkContext.broadcast((Items(rows, space), space))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, space = shared.value
            out = Out(pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("cosine", pa.float64()), ("lcs_share", pa.float64())]))
            held: list[tuple[int, np.ndarray]] = []

            def flush():
                for i, k, at, cos, share in search([w for _, w in held], items, space):
                    out.add(held[i][0], items.ids[k], at, cos, share)
                held.clear()

            n = 0
            for b in batches:
                for doc_id, w in zip(b.column("doc_id").to_pylist(), blobs(b.column("w"), np.uint32), strict=True):
                    held.append((doc_id, w))
                    n += len(w)
                    if n >= BLOCK_WORDS:
                        flush()
                        n = 0
                        if out.full():
                            yield out.take()
            flush()
            yield out.take()

        found = tokens.mapInArrow(run, "doc_id long, item_id long, first_word long, cosine double, lcs_share double")
        if len(bounds) > 2:  # one block of items is with the tasks at a time
            found = written(found, "leaks")
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
