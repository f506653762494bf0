"""Exact substring deduplication by a depth-limited radix sort of suffixes.

Suffixes matter only through ``T`` bytes. They are sorted by most significant digits, and only groups that still hold
several documents go on to the next pass:

1. The first digit of a window (the T bytes at a position) is its anchor: of its T/2-byte substrings the one with the
   least hash, the leftmost of equals. Equal windows have equal anchors at equal places, and neighbouring windows share
   theirs, so one record stands for a run of some 13 suffixes (``lo``, ``n``).
2. The second digit is the text that the run's windows span. Records equal in both digits have equal windows throughout:
   all but those of the smallest doc_id are repeats. Records alone in the second but not in the first digit go on.
3. Their windows are compared one by one through all T bytes.

Equal groups are exactly the repeated windows (digits are compared by 64- and 96-bit hashes). Every pass keeps only the
smallest document of a group before the shuffle, so a passage in very many documents costs a record for each chunk of
input. Keys travel as packed ranges; their number and the number of groups of documents follow the input size.

Every suffix as a record of its own, with its bytes as digits, would be 1.6 records of 16 bytes or more for each byte of
compressed input, beyond any disk limit; so a run of suffixes is one record, and digits are compared by hashes.

Defined results: null text is empty; texts are read whole, in blocks that overlap by a window; documents shorter than T bytes lose nothing; matches never cross documents;
repeats inside one document do not count; repeated rows (same id and text) each get the row of their document, of different texts with
one id the first one that is met is compared; an empty table gives no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.llm.common import U64, Out, buckets_for, cut, from_planes, mix, planes, rows_of, table, texts, written

T = 50
#: Bytes of text whose records are sorted together before they are sent, and of a block of positions.
CHUNK, BLOCK, PIECE = 4 << 20, 1 << 18, 1 << 15
_SENT = "bucket long, keys binary, second binary, docs binary, lo binary, n binary"
_SENT_ARROW = pa.schema([("bucket", pa.int64()), *((x, pa.binary()) for x in ("keys", "second", "docs", "lo", "n"))])
_RUNS = "g long, kind long, docs binary, lo binary, n binary"


class Rolling:
    """Hashes of all substrings of a block by prefix sums of a polynomial modulo 2**64 in an odd ``base``, which is drawn
    anew for every run, so that no text can be made to collide."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int):
        n = len(data)
        if base not in Rolling._powers or len(Rolling._powers[base][0]) < n + 1:
            m = max(n + 1, BLOCK + 4096)
            with np.errstate(over="ignore"):
                Rolling._powers = {base: tuple(np.concatenate([[U64(1)], np.cumprod(np.full(m, b, U64))]) for b in (base, pow(base, -1, 1 << 64)))}
        self.up, self.down = Rolling._powers[base]
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[U64(0)], np.cumsum((data.astype(U64) + U64(1)) * self.up[:n])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])


def _runs(data: np.ndarray, valid: np.ndarray, t: int, base: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, span hash (32 bits), first window and number of windows of every run.

    valid: whether a window may start at a position (it does not cross a document)."""
    k, w = t // 2, t - t // 2 + 1
    roll = Rolling(data, base)
    a = roll.all(k)
    low = U64((1 << 20) - 1)
    m = (a & ~low) | np.arange(len(a), dtype=U64)
    size = 1
    while size < w:
        step = min(size, w - size)
        m = np.minimum(m[:-step], m[step:])
        size += step
    at = np.nonzero(valid[: len(m)])[0]
    if not len(at):
        z = np.zeros(0, np.int64)
        return z.astype(U64), z.astype(np.uint32), z, z
    anchor = (m[at] & low).astype(np.int64)
    new = np.nonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))[0]
    lo, n = at[new], np.diff(np.append(new, len(at)))
    where = anchor[new]
    span = roll.of(lo, lo + n - 1 + t)
    with np.errstate(over="ignore"):
        span = mix(span + ((where - lo).astype(U64) << U64(32)) + n.astype(U64))
    # a least hash is small: mixed again, anchors spread evenly over the key ranges
    return mix(~a[where]), (span >> U64(32)).astype(np.uint32), lo, n


def runs_of(items: list[tuple[int, bytes]], t: int, base: int) -> tuple[np.ndarray, ...]:
    """docs, anchor, span, lo, n of the runs of some documents; lo counts from the document's start."""
    out: list[tuple[np.ndarray, ...]] = []
    block: list[tuple[int, bytes, int]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if block:
            data = np.frombuffer(b"".join(b for _, b, _ in block), np.uint8)
            length = np.array([len(b) for _, b, _ in block], np.int64)
            begin = np.concatenate([[0], np.cumsum(length)[:-1]])
            valid = np.ones(len(data), np.bool_)
            for s, n in zip(begin.tolist(), length.tolist(), strict=True):
                valid[max(s, s + n - t + 1) : s + n] = False
            a, c, lo, n = _runs(data, valid, t, base)
            which = np.searchsorted(begin, lo, side="right") - 1
            ids, shift = np.array([i for i, _, _ in block], np.int64), np.array([p for _, _, p in block], np.int64)
            out.append((ids[which], a, c, lo - begin[which] + shift[which], n))
        block.clear()
        size = 0

    for doc_id, raw in items:
        for p in range(0, max(1, len(raw) - t + 1), BLOCK):
            part = raw[p : p + BLOCK + t - 1]
            if len(part) < t:
                continue
            if size + len(part) > BLOCK + t:
                flush()
            block.append((doc_id, part, p))
            size += len(part)
    flush()
    if not out:
        z = np.zeros(0, np.int64)
        return z, z.astype(U64), z.astype(np.uint32), z, z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _least(*digits: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by digits and document, the group of each element in it, and whether it is of its group's least document."""
    by = np.lexsort((docs, *reversed(digits)))
    change = np.zeros(len(by), np.bool_)
    change[:1] = True
    for d in digits:
        x = d[by]
        change[1:] |= x[1:] != x[:-1]
    group = np.cumsum(change) - 1
    start = np.nonzero(change)[0]
    return by, group, docs[by] == docs[by][start][group] if len(by) else change


def _send(out: Out, n_buckets: int, keys, second, docs, lo, n):
    """Records in key order as rows for their key ranges."""
    full, edges = cut(keys, n_buckets)
    for b in full:
        s = slice(edges[b], edges[b + 1])
        out.add(int(b), planes(keys[s]), planes(second[s]), planes(docs[s]), planes(lo[s].astype(np.uint32)), planes(n[s].astype(np.uint32)))
        if out.full():
            yield out.take()


def _decided(out: Out, serial: int, docs, lo, n):
    """Records that are known to repeat a smaller document of the same chunk pass through."""
    for i in range(0, len(docs), PIECE):
        s = slice(i, i + PIECE)
        out.add(-1 - serial, b"", b"", planes(docs[s]), planes(lo[s].astype(np.uint32)), planes(n[s].astype(np.uint32)))
        if out.full():
            yield out.take()


def _first_pass(t: int, n_buckets: int, base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, items, size, serial = Out(_SENT_ARROW, rows=1000), [], 0, TaskContext.get().partitionId() * 1_000_003

        def flush():
            nonlocal size, serial
            docs, a, c, lo, n = runs_of(items, t, base)
            by, _, least = _least(a, c, docs=docs)
            kept, rest = by[least], by[~least]
            yield from _send(out, n_buckets, a[kept], c[kept], docs[kept], lo[kept], n[kept])
            yield from _decided(out, serial % n_buckets, docs[rest], lo[rest], n[rest])
            items.clear()
            size, serial = 0, serial + 1

        for doc_id, text in rows_of(batches, "doc_id", "text"):
            raw = text.encode("utf-8", "replace")
            items.append((doc_id, raw))
            size += len(raw)
            if size >= CHUNK:
                yield from flush()
        yield from flush()
        yield out.take()

    return run


def _records(group: pa.Table):
    kinds = {"keys": U64, "second": np.uint32, "docs": np.int64, "lo": np.uint32, "n": np.uint32}
    return [np.concatenate([from_planes(x, k) for x in group[name].to_pylist()]) for name, k in kinds.items()]


def _reply(parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], groups: int) -> pa.Table:
    rows = []
    for kind, docs, lo, n in parts:
        g = docs % groups
        by = np.argsort(g, kind="stable")
        edges = np.nonzero(np.concatenate([[True], g[by][1:] != g[by][:-1], [True]]))[0] if len(by) else [0]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            s = by[a:z]
            rows.append((int(g[s[0]]), kind, planes(docs[s]), planes(lo[s].astype(np.uint32)), planes(n[s].astype(np.uint32))))
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.table({"g": pa.array(cols[0], pa.int64()), "kind": pa.array(cols[1], pa.int64()), **{x: pa.array(c, pa.binary()) for x, c in zip(("docs", "lo", "n"), cols[2:], strict=True)}})


def _merge_first(groups: int):
    """Kind 0: repeats of a smaller document; kind 1: to be compared window by window."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            _, _, docs, lo, n = _records_decided(group)
            return _reply([(0, docs, lo, n)], groups)
        a, c, docs, lo, n = _records(group)
        by, _, least = _least(a, c, docs=docs)
        a, c, docs, lo, n = a[by], c[by], docs[by], lo[by], n[by]
        first = np.concatenate([[True], a[1:] != a[:-1]])
        run_of, start = np.cumsum(first) - 1, np.nonzero(first)[0]
        end = np.append(start[1:], len(a))
        several = (c[start] != c[end - 1]) & (np.minimum.reduceat(docs, start) != np.maximum.reduceat(docs, start))
        check = least & several[run_of]
        return _reply([(0, docs[~least], lo[~least], n[~least]), (1, docs[check], lo[check], n[check])], groups)

    return run


def _records_decided(group: pa.Table):
    docs, lo, n = (np.concatenate([from_planes(x, k) for x in group[name].to_pylist()]) for name, k in (("docs", np.int64), ("lo", np.uint32), ("n", np.uint32)))
    return None, None, docs, lo, n


def _runs_told(told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """docs, lo, n of the replies, by document."""
    if not len(told):
        z = np.zeros(0, np.int64)
        return z, z, z
    docs, lo, n = (np.concatenate([from_planes(x, k) for x in told[name].to_pylist()]) for name, k in (("docs", np.int64), ("lo", np.uint32), ("n", np.uint32)))
    by = np.argsort(docs, kind="stable")
    return docs[by], lo[by].astype(np.int64), n[by].astype(np.int64)


def _second_pass(t: int, n_buckets: int, base: int):
    def run(key: tuple, left: pa.Table, told: pa.Table) -> pa.Table:
        docs, lo, n = _runs_told(told)
        got: list[tuple[np.ndarray, ...]] = []
        seen: set[int] = set()
        for doc_id, text in zip(left["doc_id"].to_pylist(), left["text"].to_pylist(), strict=True):
            a, z = np.searchsorted(docs, [doc_id, doc_id + 1])
            if a == z or doc_id in seen:
                continue
            seen.add(doc_id)
            raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            at = np.repeat(lo[a:z], n[a:z]) + np.arange(n[a:z].sum()) - np.repeat(np.cumsum(n[a:z]) - n[a:z], n[a:z])
            at = np.unique(at[at + t <= len(raw)])
            p = 0
            while p < len(at):  # a block of the text at a time
                first = at[p]
                q = np.searchsorted(at, first + BLOCK)
                roll, rel = Rolling(raw[first : at[q - 1] + t], base), at[p:q] - first
                got.append((roll.of(rel, rel + t), np.full(q - p, doc_id, np.int64), at[p:q]))
                p = q
        out, made = Out(_SENT_ARROW, rows=1 << 30, size=1 << 40), []
        if got:
            w, d, at = (np.concatenate(x) for x in zip(*got, strict=True))
            one = np.ones(len(w), np.int64)
            by, _, least = _least(w, docs=d)
            kept, rest = by[least], by[~least]
            made += list(_send(out, n_buckets, w[kept], np.zeros(len(kept), np.uint32), d[kept], at[kept], one[kept]))
            made += list(_decided(out, key[0].as_py() % n_buckets, d[rest], at[rest], one[rest]))
        made.append(out.take())
        return pa.Table.from_batches(made, _SENT_ARROW)

    return run


def _merge_second(groups: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            _, _, docs, lo, n = _records_decided(group)
            return _reply([(2, docs, lo, n)], groups)
        w, _, docs, lo, n = _records(group)
        by, _, least = _least(w, docs=docs)
        hit = by[~least]
        return _reply([(2, docs[hit], lo[hit], n[hit])], groups)

    return run


def _apply(t: int):
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]

    def run(key: tuple, left: pa.Table, told: pa.Table) -> pa.Table:
        docs, lo, n = _runs_told(told)
        rows = []
        for doc_id, text in zip(left["doc_id"].to_pylist(), left["text"].to_pylist(), strict=True):
            raw = text.encode("utf-8", "replace")
            a, z = np.searchsorted(docs, [doc_id, doc_id + 1])
            if a == z:
                rows.append((doc_id, len(raw), 0, 0, raw))
                continue
            edge = np.zeros(len(raw) + 1, np.int32)
            np.add.at(edge, lo[a:z], 1)
            np.add.at(edge, np.minimum(lo[a:z] + n[a:z] - 1 + t, len(raw)), -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
            rows.append((doc_id, len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return pa.table([pa.array(c, f) for c, (_, f) in zip(cols, fields, strict=True)], names=[f for f, _ in fields])

    return run


def _groups(docs: DataFrame) -> int:
    """A prime number of groups of documents, some 4 MB of input each."""
    n = max(7, buckets_for(docs, 4 << 20))
    while any(n % p == 0 for p in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def remove_repeats(docs: DataFrame, t: int = T) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every document that has an id."""
    if t < 4:
        raise ValueError("t must be 4 at least")
    n_buckets, groups, base = buckets_for(docs), _groups(docs), random.SystemRandom().getrandbits(64) | 5
    d = texts(docs)
    sent = d.mapInArrow(_first_pass(t, n_buckets, base), _SENT)
    told = written(sent.groupBy("bucket").applyInArrow(_merge_first(groups), _RUNS), "runs")
    dealt = d.select("*", F.pmod("doc_id", F.lit(groups)).alias("g"))
    # only groups of documents that have something to compare are dealt out
    check = told.where("kind = 1")
    windows = dealt.groupBy("g").cogroup(check.groupBy("g")).applyInArrow(_second_pass(t, n_buckets, base), _SENT)
    more = written(windows.groupBy("bucket").applyInArrow(_merge_second(groups), _RUNS), "windows")
    every = told.where("kind = 0").unionByName(more)
    return dealt.groupBy("g").cogroup(every.groupBy("g")).applyInArrow(_apply(t), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
