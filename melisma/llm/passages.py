"""Near-duplicate passages by compact windows.

The tokens of a document are its shingles of five words. For each of ``K`` hash functions a compact window (l, c, r) is
a node of the Cartesian tree over the hashes, with the range it spans: every subsequence of [l, r] that holds c has its
minimum there. Only windows of at least ``t`` shingles matter; their nodes are exactly the minima of the sliding windows
of length t, and the bounds of a node follow from the nodes alone, since a node's ancestors span more than it does.

Two documents share a window's signature if the least shingle is the same. Windows with one signature are compared only
if they also agree in the eleven shingles to the left or to the right of it: two passages of fifty words at similarity
0.8 have at most one edit and so a run of twenty common shingles or more. In such a group

* windows that agree in all of the ``REACH`` shingles on both sides are equal passages: each is linked to the smallest
  document's, which stands for them from then on (in a chunk of input first, then over all);
* up to ``SMALL`` others are paired all with all;
* a larger group is split by the ``LAID`` stretches of shingles that lie over the window at every ``STEP``: two passages of
  fifty words that are equal share such a stretch, and those that share a line with many more documents share one that
  reaches out of the line. Stretches of up to ``SMALL`` windows are paired all with all; in larger ones every window meets
  the first, its predecessor, and the one that shares most large stretches with others. Where verified links then leave
  more than ``OUTSIDE`` windows outside a group's largest class, they are compared with the best linked document of each of
  its two largest classes, such as the original of many passages that differ from it in a word each, as long as this joins
  classes;
* what is still in different classes of a large group is compared in full, in blocks, so that every two windows of a group
  end in one class, have been compared, or have too few shingles in common to pass.

A region of a document is a candidate when the windows of ``NEED`` functions meet in it (a stabbing join of their
intervals). For each pair of documents and alignment the place where most windows meet is verified on the shingles around
it, and for pairs that this leaves in different classes all further places along the alignment: a passage of ``WORDS``
words and its counterpart must have a Jaccard similarity of ``SIMILARITY`` or more. Classes are the connected components
of what passes.

Defined results: null text is empty; documents of fewer than ``WORDS`` words have no passage and are classes of their
own; texts are read whole, in blocks that overlap by a window; of equal hashes the leftmost is the minimum; repeats inside a
document do not count; repeated rows (same id and text) count once and give repeated output rows, of different texts with
one id the first one that is met counts; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.llm.common import LOWER, U64, Out, blobs, buckets_for, cut, forget, from_planes, mix, planes, rows_of, table, texts, written
from melisma.llm.components import components

SHINGLE, WORDS, SIMILARITY = 5, 50, 0.8
K, NEED, SIDE, SMALL, AROUND = 6, 3, 10, 16, 64
#: Stretches of LAID shingles at every STEP that hold a window's least shingle; they cover REACH shingles on both sides.
LAID, STEP = 31, 5
REACH = LAID - 1
_OVER = range(0, LAID, STEP)
_LAID = [f"w{a}" for a in _OVER]
#: Windows of a large group in one block, and of a shingle that a block's rare shingles have at most.
MEMBERS, RARE = 1 << 15, 16
#: Windows outside the largest class of a group beyond which best linked documents meet the rest before all do.
OUTSIDE = 1 << 11
#: Documents, at most, whose ids are sent to all texts to pick theirs.
FEW = 100_000
#: Rounds, at most, in which the best linked documents of the two largest classes of a large group meet the rest.
ROUNDS = 8
#: Marks a link of equal passages in its function's number.
SURE = 8
T = WORDS - SHINGLE + 1
#: Different shingles that a passage, or its counterpart, may have for itself: with i in common i <= T, and i >= SIMILARITY * (i + own).
MISSING = int(T * (1 / SIMILARITY - 1) + 1e-9)
CHUNK, BLOCK, PIECE = 6 << 20, 1 << 18, 1 << 15
#: Bytes of input for each key range and group of documents; many links of near copies may meet in one.
RANGE = 1 << 20
#: Shingles around a place with those on both sides, and groups of documents that send theirs together.
WIDE, WIDER = 2 * AROUND + 1, 8
#: Words by which the places of a passage may be moved against its counterpart's.
SLACK = 3
_SEEDS = [U64(xxhash.xxh64_intdigest(b"window %d" % k)) for k in range(K)]
_ENTRY = {"keys": U64, "left": np.uint32, "right": np.uint32, "docs": np.int64, "c": np.uint32, "dl": np.uint16, "dr": np.uint16, "full": np.uint8, **dict.fromkeys(_LAID, np.uint16)}
_LINK = {"m": np.int64, "r": np.int64, "cm": np.uint32, "cr": np.uint32, "dl": np.uint16, "dr": np.uint16, "k": np.uint8}
_ALL = {**_ENTRY, **{x: v for x, v in _LINK.items() if x not in _ENTRY}}
_SENT = "bucket long, " + ", ".join(f"{x} binary" for x in _ALL)
_SENT_ARROW = pa.schema([("bucket", pa.int64()), *((x, pa.binary()) for x in _ALL)])
_TOLD = "g long, " + ", ".join(f"{x} binary" for x in _LINK)


def shingles(text: str) -> np.ndarray:
    """Hashes of the five-word shingles of a text, in order."""
    w = text.encode("utf-8", "replace").translate(LOWER).split()
    if len(w) < SHINGLE:
        return np.zeros(0, U64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), U64, len(w))
    n = len(w) - SHINGLE + 1
    with np.errstate(over="ignore"):
        s = h[:n].copy()
        for i in range(1, SHINGLE):
            s = s * U64(0x9E3779B97F4A7C55) + h[i : i + n]
        return mix(s)


def compact_windows(a: np.ndarray, t: int, bars: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c, r of all compact windows of at least t tokens; of equal hashes the leftmost is the minimum.

    Hashes are compared by their upper 43 bits, so ``a`` has fewer than 2**20 tokens. bars: places (in order) that no
    window may hold, such as those between documents."""
    z = np.zeros(0, np.int64)
    if len(a) < t:
        return z, z, z
    low = U64((1 << 20) - 1)
    key = (a & ~low) | (low + U64(1)) | np.arange(len(a), dtype=U64)  # never zero, which is a bar
    bars = z if bars is None else bars
    key[bars] = 0
    m, size = key, 1
    while size < t:
        step = min(size, t - size)
        m = np.minimum(m[:-step], m[step:])
        size += step
    # a sliding minimum keeps its place for a run of starts; windows with a bar have the minimum 0
    m = m[np.concatenate([[True], m[1:] != m[:-1]])]
    c = np.unique((m[m > 0] & low).astype(np.int64))
    # nodes and bars in order: a node's bounds are the nearest lesser ones on both sides
    at = np.concatenate([c, bars])
    by = np.argsort(at, kind="stable")
    at, node = at[by], (np.arange(len(at)) < len(c))[by]
    places, v = at.tolist(), key[at].tolist()
    left, right, stack = [0] * len(places), [len(a) - 1] * len(places), []
    for i, x in enumerate(v):
        while stack and v[stack[-1]] > x:
            right[stack.pop()] = places[i] - 1
        left[i] = places[stack[-1]] + 1 if stack else 0
        if x:
            stack.append(i)
        else:  # nothing reaches over a bar
            stack = [i]
    return np.array(left)[node], at[node], np.array(right)[node]


def runs(s: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` tokens from each place, put together from those of powers of two; the last ones are of no use."""
    out, reach, part, step, power, n = np.zeros_like(s), 0, s, 1, U64(0x9E3779B97F4A7C55), len(s)
    with np.errstate(over="ignore"):
        while step <= size:
            if size & step:
                out = out * power
                out[: n - reach] += part[reach:]
                reach += step
            double = part * power
            double[: max(0, n - step)] += part[step:]
            part, power, step = double, power * power, 2 * step
    return out


def _pack(**arrays: np.ndarray) -> list[bytes]:
    return [planes(arrays[x].astype(kind)) if x in arrays else b"" for x, kind in _ALL.items()]


def _unpack(group: pa.Table, kinds: dict) -> list[np.ndarray]:
    return [np.concatenate([from_planes(x, kind) for x in group[name].to_pylist()] or [np.zeros(0, kind)]) for name, kind in kinds.items()]


def _entries(items: list[tuple[int, str]]) -> dict[str, np.ndarray]:
    """All windows of some documents, with their contexts and functions."""
    kinds = {**_ENTRY, "k": np.uint8}
    out: dict[str, list] = {x: [] for x in kinds}
    block: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if block:
            for x, v in _windows_of(block).items():
                out[x].append(v)
        block.clear()
        size = 0

    for doc_id, text in items:
        s = shingles(text)
        for p in range(0, max(1, len(s) - T + 1), BLOCK):
            part = s[max(0, p - SIDE) : p + BLOCK + T + SIDE]
            if len(part) < T:
                continue
            if size + len(part) > 2 * BLOCK:
                flush()
            block.append((doc_id, max(0, p - SIDE), part))
            size += len(part) + 1
    flush()
    return {x: np.concatenate(v).astype(kinds[x]) if v else np.zeros(0, kinds[x]) for x, v in out.items()}


def _windows_of(block: list[tuple[int, int, np.ndarray]]) -> dict[str, np.ndarray]:
    """The windows of parts of documents (id, first shingle, shingles), laid end to end with a bar before each."""
    s = np.concatenate([x for _, _, part in block for x in (np.zeros(1, U64), part)])
    size = np.array([len(part) + 1 for *_, part in block], np.int64)
    bars = np.concatenate([[0], np.cumsum(size)[:-1]])
    ids, first = np.array([d for d, *_ in block], np.int64), np.array([p for _, p, _ in block], np.int64)
    n = len(s)
    with np.errstate(over="ignore"):
        run, laid = mix(runs(s, SIDE + 1)) >> U64(32), mix(runs(s, LAID)) >> U64(48)
    found: dict[str, list] = {x: [] for x in (*_ENTRY, "k")}
    for k, seed in enumerate(_SEEDS):
        f = mix(s ^ seed)
        l, c, r = compact_windows(f, T, bars)
        which = np.searchsorted(bars, c, side="right") - 1
        own = (f[c] ^ ids[which].astype(U64)) & U64(0xFFFFFFFF)
        # a context that the text cuts short agrees with none
        left = np.where(c - bars[which] > SIDE, run[np.maximum(c - SIDE, 0)], own)
        right = np.where(c + SIDE < bars[which] + size[which], run[c], own)
        wide, begin, end = [], bars[which], bars[which] + size[which]
        for a in _OVER:  # neither does a stretch
            inside = (c - a > begin) & (c - a + LAID <= end)
            wide.append(np.where(inside, laid[np.maximum(c - a, 0)], (own + U64(a)) & U64(0xFFFF)))
        full = (c - REACH > begin) & (c + LAID <= end)
        values = (mix(f[c] + U64(k)), left, right, ids[which], c - begin - 1 + first[which], np.minimum(c - l, 65535), np.minimum(r - c, 65535), full, *wide, np.full(len(c), k))
        for x, v in zip(found, values, strict=True):
            found[x].append(v)
    return {x: np.concatenate(v) for x, v in found.items()}


def _told(e: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, sure: int = 0) -> dict[str, np.ndarray]:
    """Links between the windows i and j of different documents, from the larger document to the smaller."""
    differ = e["docs"][i] != e["docs"][j]
    i, j = i[differ], j[differ]
    swap = e["docs"][i] < e["docs"][j]
    a, b = np.where(swap, j, i), np.where(swap, i, j)
    return {"m": e["docs"][a], "r": e["docs"][b], "cm": e["c"][a], "cr": e["c"][b], "dl": e["dl"][a], "dr": e["dr"][a], "k": e["k"][a] | np.uint8(sure)}


def _groups_of(*digits: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by digits, then by ``last``; the place where the group of each element in it begins, and its size."""
    by = np.lexsort((last, *reversed(digits)))
    new = np.zeros(len(by), np.bool_)
    new[:1] = True
    for d in digits:
        new[1:] |= d[by][1:] != d[by][:-1]
    start = np.nonzero(new)[0]
    which = np.cumsum(new) - 1
    return by, start[which] if len(by) else start, np.diff(np.append(start, len(by)))[which] if len(by) else start


def _all_pairs(by: np.ndarray, head: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of all groups of up to ``SMALL`` elements."""
    at = np.nonzero((size > 1) & (size <= SMALL))[0]
    found = [(at[at - d >= head[at]], d) for d in range(1, SMALL)]
    return np.concatenate([by[x] for x, _ in found]), np.concatenate([by[x - d] for x, d in found])


def _equal(e: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Links of the windows whose surroundings equal those of a smaller document, and which windows are left."""
    keep = np.ones(len(e["keys"]), np.bool_)
    at = np.nonzero(e["full"])[0]
    z = e["keys"][at] ^ (e["left"][at].astype(U64) << U64(32)) ^ e["right"][at]
    for x in _LAID:
        z = mix(z + e[x][at])
    by, head, size = _groups_of(z, last=e["docs"][at])
    rest = np.arange(len(by)) > head
    i, j = at[by[rest]], at[by[head[rest]]]
    keep[i] = False
    return _told(e, i, j, SURE), keep


def _paired(e: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], list[tuple[np.ndarray, ...]]]:
    """Links between windows of equal signature and context, and the windows (group, document, place, function) of large groups."""
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    members: list[tuple[np.ndarray, ...]] = []
    crowded = np.zeros(len(e["keys"]), np.bool_)
    for side in ("left", "right"):
        by, head, size = _groups_of(e["keys"], e[side], last=e["docs"])
        pairs.append(_all_pairs(by, head, size))
        many = by[size > SMALL]
        crowded[many] = True
        pairs.append((many, by[head[size > SMALL]]))
        members.append((mix(e["keys"][many] + (e[side][many].astype(U64) << U64(1)) + U64(side == "left")).view(np.int64), e["docs"][many], e["c"][many], e["k"][many]))
    at = np.nonzero(crowded)[0]
    laid = [_groups_of(e["keys"][at], e[x][at], last=e["docs"][at]) for x in _LAID]
    shared = np.zeros(len(at), np.int64)
    for by, _, size in laid:
        shared[by] += size > SMALL
    for by, head, size in laid:
        i, j = _all_pairs(by, head, size)
        pairs.append((at[i], at[j]))
        place = np.nonzero(size > SMALL)[0]
        if len(place):
            begin = head[place]
            # of each large group the window with most large groups of its own
            best = place[np.lexsort((-shared[by[place]], begin))]
            best = best[np.concatenate([[True], head[best][1:] != head[best][:-1]])]
            hub = best[np.searchsorted(head[best], begin)]
            for other in (begin, np.maximum(begin, place - 1), hub):
                pairs.append((at[by[place]], at[by[other]]))
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    n = max(1, len(e["keys"]))
    one = np.unique(np.minimum(i, j) * n + np.maximum(i, j))
    return _told(e, one // n, one % n), members


def _first_pass(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, items, size, serial = Out(_SENT_ARROW, rows=1000), [], 0, TaskContext.get().partitionId() * 1_000_003

        def flush():
            nonlocal size, serial
            e = _entries(items)
            links, keep = _equal(e)
            for i in range(0, len(links["m"]), PIECE):
                out.add(-1 - (serial + i // PIECE) % n_buckets, *_pack(**{x: v[i : i + PIECE] for x, v in links.items()}))
            e = {x: v[keep] for x, v in e.items()}
            by = np.argsort(e["keys"], kind="stable")
            e = {x: v[by] for x, v in e.items()}
            full, edges = cut(e["keys"], n_buckets)
            for b in full:
                out.add(int(b), *_pack(**{x: v[edges[b] : edges[b + 1]] for x, v in e.items()}))
                if out.full():
                    yield out.take()
            items.clear()
            size, serial = 0, serial + 1

        for row in rows_of(batches, "doc_id", "text"):
            items.append(row)
            size += len(row[1])
            if size >= CHUNK:
                yield from flush()
        yield from flush()
        yield out.take()

    return run


def _reply(links: list[dict[str, np.ndarray]], groups: int) -> pa.Table:
    """Links as rows for the groups of their member documents."""
    x = {n: np.concatenate([y[n] for y in links]).astype(k) for n, k in _LINK.items()}
    g = x["m"] % groups
    by = np.argsort(g, kind="stable")
    g = g[by]
    edges = np.nonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))[0] if len(g) else np.zeros(1, np.int64)
    cols: dict[str, list] = {n: [] for n in _LINK}
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        for n in _LINK:
            cols[n].append(planes(x[n][by[a:z]]))
    return pa.table({"g": pa.array(g[edges[:-1]] if len(g) else [], pa.int64()), **{n: pa.array(c, pa.binary()) for n, c in cols.items()}})


def _merge(groups: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return _reply([dict(zip(_LINK, _unpack(group, _LINK), strict=True))], groups)
        kinds = {**_ENTRY, "k": np.uint8}
        e = dict(zip(kinds, _unpack(group, kinds), strict=True))
        by = np.argsort(e["keys"], kind="stable")
        key_of = e["keys"][by]
        links, members, p = [], [], 0
        while p < len(by):  # whole signatures at a time, so that pairs do not gather
            q = int(np.searchsorted(key_of, key_of[min(p + PIECE, len(by)) - 1], side="right"))
            part = {x: v[by[p:q]] for x, v in e.items()}
            equal, keep = _equal(part)
            paired, large = _paired({x: v[keep] for x, v in part.items()})
            links += [equal, paired]
            members += large
            p = q
        rows = _reply(links or [{x: np.zeros(0, kind) for x, kind in _LINK.items()}], groups)
        large = [{**dict.fromkeys(_LINK, b""), "r": planes(gid), "m": planes(docs), "cm": planes(c), "k": planes(k)} for gid, docs, c, k in members if len(docs)]
        return pa.concat_tables([rows, pa.Table.from_pylist([{"g": -1, **x} for x in large], rows.schema)])

    return run


def _candidates(key: tuple, group: pa.Table) -> pa.Table:
    """Places of each pair of documents and alignment, in regions where the windows of enough functions meet; the densest
    has rank 0, those that cover the rest of the alignment follow. Links of equal passages have rank -1, one for each pair."""
    x = dict(zip(_LINK, _unpack(group, _LINK), strict=True))
    # a place in all documents of the group: documents are spaced so that no interval reaches the next
    ids, which = np.unique(x["m"], return_inverse=True)
    cm, cr = x["cm"].astype(np.int64), x["cr"].astype(np.int64)
    span = int(cm.max(initial=0)) + 200_000
    at = which * span + cm
    lo, hi = at - np.minimum(x["dl"], cm), at + x["dr"]
    met, function, sure = np.zeros(len(at), np.int64), x["k"] & (SURE - 1), (x["k"] & SURE) > 0
    for k in range(K):
        p = np.sort(at[function == k])
        met += np.searchsorted(p, hi, side="right") > np.searchsorted(p, lo)
    equal = np.nonzero(sure)[0]
    equal = equal[np.lexsort((cm[equal], x["r"][equal], x["m"][equal]))]
    if len(equal):
        equal = equal[np.concatenate([[True], (x["m"][equal][1:] != x["m"][equal][:-1]) | (x["r"][equal][1:] != x["r"][equal][:-1])])]
    ok = np.nonzero((met >= NEED) & ~sure)[0]
    shift = cm - cr
    by = ok[np.lexsort((cm[ok], shift[ok], x["r"][ok], x["m"][ok]))]
    rank = np.zeros(0, np.int64)
    if len(by):
        m, r, s, c = x["m"][by], x["r"][by], shift[by], cm[by]
        new = np.ones(len(by), np.bool_)
        new[1:] = (m[1:] != m[:-1]) | (r[1:] != r[:-1]) | (s[1:] != s[:-1]) | (c[1:] - c[:-1] > 2 * T)
        run = np.cumsum(new) - 1
        place = run * (span + 4 * T) + c
        dense = np.searchsorted(place, place + T // 2, side="right") - np.searchsorted(place, place - T // 2)
        first = np.nonzero(new)[0]
        order = np.lexsort((-dense, run))
        best = order[np.concatenate([[True], run[order][1:] != run[order][:-1]])]
        # one place of each stretch of AROUND // 2 along the alignment, so that all windows are in sight of one
        cell = (c - c[first][run]) // (AROUND // 2)
        cover = np.nonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (cell[1:] != cell[:-1])]))[0]
        cover = cover[~np.isin(cover, best)]
        picked = np.concatenate([best, cover])
        rank = np.concatenate([np.zeros(len(best), np.int64), np.ones(len(cover), np.int64)])
        by = by[picked]
    by, rank = np.concatenate([equal, by]), np.concatenate([np.full(len(equal), -1), rank])
    return pa.table({"m": x["m"][by], "cm": cm[by], "r": x["r"][by], "cr": cr[by], "rank": rank.astype(np.int64)})


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            cols = [from_planes(row[x], kind).astype(np.int64) for x, kind in (("r", np.int64), ("m", np.int64), ("cm", np.uint32), ("k", np.uint8))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["gid", "d", "c", "k"])


def _contexts(key: tuple, left: pa.Table, asked: pa.Table) -> pa.Table:
    """The shingles (32 bits) around each asked place of a document, and how many of them come before the place."""
    want: dict[int, list[int]] = {}
    for d, c in zip(asked["d"].to_pylist(), asked["c"].to_pylist(), strict=True):
        want.setdefault(d, []).append(c)
    rows, seen = [], set()
    for doc_id, text in zip(left["doc_id"].to_pylist(), left["text"].to_pylist(), strict=True):
        if doc_id not in want or doc_id in seen:
            continue
        seen.add(doc_id)
        s = (shingles(text) >> U64(32)).astype(np.uint32)
        for c in want[doc_id]:
            a = max(0, c - AROUND)
            rows.append((doc_id, c, c - a, s[a : c + AROUND + 1].tobytes()))
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table({"d": pa.array(cols[0], pa.int64()), "c": pa.array(cols[1], pa.int64()), "before": pa.array(cols[2], pa.int64()), "ctx": pa.array(cols[3], pa.binary())})


def best_passage(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """The greatest similarity of a passage of T shingles of ``a`` to its counterpart in ``b``, and its first shingle; 0 if
    none reaches ``SIMILARITY``. The counterpart spans the passage's shingles in ``b``, and T shingles at least."""
    if len(a) < T or len(b) < T:
        return 0.0, 0

    def before(x: np.ndarray, order: np.ndarray) -> np.ndarray:
        """The last place before each one that holds the same shingle."""
        out = np.full(len(x), -1)
        same = x[order][1:] == x[order][:-1]
        out[order[1:][same]] = order[:-1][same]
        return out

    order = np.argsort(b, kind="stable")
    p = np.minimum(np.searchsorted(b[order], a), len(b) - 1)
    place = np.where(b[order][p] == a, order[p], -1)
    starts = np.arange(len(a) - T + 1)[:, None]
    view = np.lib.stride_tricks.sliding_window_view
    rows, new = view(place, T), view(before(a, np.argsort(a, kind="stable")), T) < starts
    lo, hi = np.where(rows >= 0, rows, len(b)).min(axis=1), rows.max(axis=1) + 1
    lo = np.where(hi - lo < T, np.minimum(np.maximum(0, hi - T), len(b) - T), lo)
    hi = np.maximum(hi, lo + T)
    # different shingles of the passage, of its counterpart, and of both
    own, common, at = new.sum(axis=1), (new & (rows >= 0)).sum(axis=1), np.arange(len(b))
    other = ((at >= lo[:, None]) & (at < hi[:, None]) & (before(b, order) < lo[:, None])).sum(axis=1)
    j = common / (own + other - common)
    i = int(j.argmax())
    return (float(j[i]), i) if j[i] >= SIMILARITY else (0.0, 0)


def _aligned(parts: list[np.ndarray], before: np.ndarray, fill: int) -> np.ndarray:
    """Contexts as rows of one matrix with their places in one column; 64 bits, so that fillers equal nothing."""
    out = np.full((len(parts), 2 * AROUND + 1 + 2 * SLACK), fill, np.int64)
    size = np.array([len(x) for x in parts], np.int64)
    row = np.repeat(np.arange(len(parts)), size)
    within = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out[row, SLACK + AROUND - before[row] + within] = np.concatenate(parts)
    return out


def verify(am: list[np.ndarray], before_m: np.ndarray, ar: list[np.ndarray], before_r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of contexts the similarity of its best passage (below SIMILARITY if none passes) and the passage's
    first shingle in the first context. Contexts without T shingles in common places, up to SLACK, need no closer look; where
    T different shingles stand in the same places, their share is the similarity (or less, if others are in common too)."""
    similarity, start = np.zeros(len(am)), np.zeros(len(am), np.int64)
    if not len(am):
        return similarity, start
    a, b = _aligned(am, before_m, -1), _aligned(ar, before_r, -2)
    n = 2 * AROUND + 1


    def within(hit: np.ndarray) -> np.ndarray:
        """How many of each T places are hits."""
        total = np.pad(np.cumsum(hit, axis=1, dtype=np.int16), ((0, 0), (1, 0)))
        return total[:, T:] - total[:, :-T]

    straight = a[:, SLACK : SLACK + n] == b[:, SLACK : SLACK + n]
    same = within(straight)
    best, most = same.argmax(axis=1), same.max(axis=1)
    # with i of T shingles in common, and all different, the similarity is i / (2 T - i)
    enough = int(np.ceil(2 * T * SIMILARITY / (1 + SIMILARITY) - 1e-9))
    ok = np.nonzero(most >= enough)[0]
    place = SLACK + best[ok, None] + np.arange(T)
    x, y = np.sort(a[ok[:, None], place], axis=1), np.sort(b[ok[:, None], place], axis=1)
    plain = (x[:, 0] >= 0) & (y[:, 0] >= 0) & (x[:, 1:] != x[:, :-1]).all(axis=1) & (y[:, 1:] != y[:, :-1]).all(axis=1)
    start[ok] = best[ok] - (AROUND - before_m[ok])
    similarity[ok[plain]] = most[ok[plain]] / (2 * T - most[ok[plain]])
    for i in ok[~plain & (x[:, 0] >= 0) & (y[:, 0] >= 0)].tolist():  # with repeated shingles, by their sets
        at = SLACK + int(best[i])
        p, q = set(a[i, at : at + T].tolist()), set(b[i, at : at + T].tolist())
        j = len(p & q) / len(p | q)
        similarity[i] = j if j >= SIMILARITY else 0.0
    # a passage with an added or missing word matches in two alignments; more of them leave too little in common
    rest = np.nonzero(similarity == 0)[0]
    reach, a, b, straight = most[rest], a[rest], b[rest], straight[rest]
    for s in range(2 * SLACK + 1):
        both = straight | (a[:, SLACK : SLACK + n] == b[:, s : s + n])
        some = np.nonzero(both.sum(axis=1) >= enough)[0] if s != SLACK else []
        if len(some):
            reach[some] = np.maximum(reach[some], within(both[some]).max(axis=1))
    # passages with words moved or added
    for i in rest[reach >= enough].tolist():
        similarity[i], start[i] = best_passage(am[i], ar[i])
    return similarity, start


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        am, ar = blobs(batch.column("am"), np.uint32), blobs(batch.column("ar"), np.uint32)
        before = batch.column("before").to_numpy()
        j, i = verify(am, before, ar, batch.column("before_r").to_numpy())
        ok = np.nonzero(j >= SIMILARITY)[0]
        yield pa.RecordBatch.from_arrays([batch.column("m").take(pa.array(ok)), batch.column("r").take(pa.array(ok)), pa.array((batch.column("cm").to_numpy() - before + i)[ok]), pa.array(j[ok])], names=["m", "r", "first_word", "similarity"])


def _groups(docs: DataFrame) -> int:
    n = max(7, buckets_for(docs, RANGE))
    while any(n % p == 0 for p in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _around(places: DataFrame, dealt: DataFrame) -> DataFrame:
    """The shingles around the places (d, c, g), as a table. Only the texts that are asked for travel, if they are few."""
    places = written(places, "places")
    ids = places.select(F.col("d").alias("doc_id")).distinct()
    if ids.count() <= FEW:
        dealt = dealt.join(F.broadcast(ids), "doc_id", "left_semi")
    out = written(dealt.groupBy("g").cogroup(places.groupBy("g")).applyInArrow(_contexts, "d long, c long, before long, ctx binary"), "contexts")
    forget(places)
    return out


def _shown(asked: DataFrame, dealt: DataFrame, groups: int, name: str, also: DataFrame | None = None) -> DataFrame:
    """m, r, first_word and similarity of the verified ones of the asked places (m, cm, r, cr), and ``also``, as a table."""
    places = asked.select(F.col("m").alias("d"), F.col("cm").alias("c")).unionByName(asked.select(F.col("r").alias("d"), F.col("cr").alias("c"))).distinct()
    ctx = _around(places.select("*", F.pmod("d", F.lit(groups)).alias("g")), dealt)
    member = ctx.select(F.col("d").alias("m"), F.col("c").alias("cm"), "before", F.col("ctx").alias("am"))
    known = ctx.select(F.col("d").alias("r"), F.col("c").alias("cr"), F.col("before").alias("before_r"), F.col("ctx").alias("ar"))
    both = asked.join(member, ["m", "cm"]).join(known, ["r", "cr"])
    shown = both.mapInArrow(_verified, "m long, r long, first_word long, similarity double")
    shown = written(shown if also is None else also.unionByName(shown), name)
    forget(ctx)
    return shown


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """m, r (documents, r < m), first_word (of the passage in m) and similarity of the verified links, and node, root of the
    classes that they make."""
    n_buckets, groups = buckets_for(docs, RANGE), _groups(docs)
    d = texts(docs)
    sent = d.mapInArrow(_first_pass(n_buckets), _SENT)
    told = sent.groupBy("bucket").applyInArrow(_merge(groups), _TOLD)
    told = written(told, "told")
    candidates = written(told.where("g >= 0").groupBy("g").applyInArrow(_candidates, "m long, cm long, r long, cr long, rank long"), "candidates")
    crowd = written(told.where("g < 0").select("r", "m", "cm", "k").mapInArrow(_members, "gid long, d long, c long, k long"), "crowd")
    forget(told)
    dealt = d.select("*", F.pmod("doc_id", F.lit(groups)).alias("g"))
    sure = candidates.where("rank = -1").select("m", "r", F.greatest(F.lit(0), F.col("cm") - REACH).alias("first_word"), F.lit(1.0).alias("similarity"))
    found = _shown(candidates.where("rank = 0").select("m", "cm", "r", "cr"), dealt, groups, "links", sure)
    parts = written(components(found.select(F.col("r").alias("a"), F.col("m").alias("b"))), "parts")
    asked, tried = candidates.where("rank = 1").select("m", "cm", "r", "cr"), _cells(candidates.where("rank = 0")).drop("cm", "cr")
    rest = written(_cells(_apart(asked, parts)).join(tried, _CELL, "left_anti"), "rest")
    more = _shown(rest.select("m", "cm", "r", "cr"), dealt, groups, "more")
    if not more.isEmpty():
        parts, found = written(_joined(parts, more).drop("changed"), "parts"), found.unionByName(more)
    tried = tried.unionByName(rest.select(*_CELL))
    known = written(_several(_rooted(crowd, parts, "d")), "known")
    forget(crowd)
    members, met, settled = written(_outside(known).groupBy("gid", "d", "k").agg(F.min("c").alias("c")), "members"), None, parts
    for _ in range(ROUNDS):
        if members.isEmpty():
            break
        now = _known(members, parts, found)
        hubs = written(_hubs(now), "hubs")
        # what is not in the class of a hub now has met it when it became one
        new = hubs if met is None else hubs.join(hubs.join(met, ["gid", "e"], "left_anti").select("e").distinct(), "e", "left_semi")
        met = hubs.select("gid", "e") if met is None else met.unionByName(new.select("gid", "e"))
        rest = written(_meetings(now, new).join(tried, _CELL, "left_anti"), "rest")
        if rest.isEmpty():
            break
        more = _shown(rest.select("m", "cm", "r", "cr"), dealt, groups, "more")
        if more.isEmpty():
            break
        parts = written(_joined(parts, more), "parts")
        # only groups that a joined class has members in can have other hubs than before
        touched = members.join(parts.where("changed").select(F.col("node").alias("d")), "d", "left_semi").select("gid").distinct()
        members, parts, found = written(members.join(touched, "gid", "left_semi"), "members"), parts.drop("changed"), found.unionByName(more)
        tried = tried.unionByName(rest.select(*_CELL))
    forget(candidates)
    if parts is not settled:
        known = written(_several(_rooted(known.drop("of_d"), parts, "d")), "known")
    more = _remaining(known, dealt, groups)
    if not more.isEmpty():
        parts, found = written(_joined(parts, more).drop("changed"), "parts"), found.unionByName(more)
    return found, parts


def _joined(parts: DataFrame, more: DataFrame) -> DataFrame:
    """The classes after further links; those that are joined get one root and are marked, all others stay as they are."""
    joined = components(_rooted(_rooted(more.select("m", "r").distinct(), parts, "m"), parts, "r").select(F.col("of_m").alias("a"), F.col("of_r").alias("b")))
    single = more.select(F.explode(F.array("m", "r")).alias("node")).distinct().join(parts, "node", "left_anti").select("node", F.col("node").alias("root"))
    renamed = joined.select(F.col("node").alias("root"), F.col("root").alias("least"))
    return parts.unionByName(single).join(renamed, "root", "left").select("node", F.coalesce("least", "root").alias("root"), F.col("least").isNotNull().alias("changed"))


_CELL = ["m", "r", "shift", "cell"]


def _cells(asked: DataFrame) -> DataFrame:
    """One of the places that lie so near on one alignment that each sees all passages through the others."""
    shift, cell = (F.col("cm") - F.col("cr")).alias("shift"), F.floor(F.col("cm") / (AROUND + 1 - T)).alias("cell")
    return asked.groupBy("m", "r", shift, cell).agg(F.min("cm").alias("cm")).withColumn("cr", F.col("cm") - F.col("shift"))


def _rooted(x: DataFrame, parts: DataFrame, column: str) -> DataFrame:
    """The rows with the class of the document in ``column``."""
    known = parts.select(F.col("node").alias(column), F.col("root").alias(f"of_{column}"))
    return x.join(known, column, "left").withColumn(f"of_{column}", F.coalesce(f"of_{column}", column))


def _apart(asked: DataFrame, parts: DataFrame) -> DataFrame:
    return _rooted(_rooted(asked, parts, "m"), parts, "r").where("of_m != of_r").select("m", "cm", "r", "cr")


def _known(members: DataFrame, parts: DataFrame, found: DataFrame) -> DataFrame:
    """The members of large groups with their classes and numbers of links."""
    degree = found.select(F.explode(F.array("m", "r")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    known = parts.join(degree, "node", "left").select(F.col("node").alias("d"), F.col("root").alias("of_d"), "degree")
    return members.join(known, "d", "left").withColumns({"of_d": F.coalesce("of_d", "d"), "degree": F.coalesce("degree", F.lit(0))})


def _hubs(known: DataFrame) -> DataFrame:
    """gid, root, e, ce: the best linked member of each of the two largest classes of every group that holds several."""
    classes = known.groupBy("gid", "of_d").agg(F.count("*").alias("n"), F.max_by(F.struct("d", "c"), F.struct("degree", -F.col("d"), -F.col("c"))).alias("hub"))
    several = classes.groupBy("gid").agg(F.count("*").alias("k"), F.max(F.struct("n", F.col("of_d").alias("root"), "hub")).alias("top")).where("k > 1")
    first = several.select("gid", "top.root", "top.hub")
    second = classes.join(first.select("gid", F.col("root").alias("_top")), "gid").where("of_d != _top").groupBy("gid").agg(F.max(F.struct("n", F.col("of_d").alias("root"), "hub")).alias("top")).select("gid", "top.root", "top.hub")
    return first.unionByName(second).select("gid", "root", F.col("hub.d").alias("e"), F.col("hub.c").alias("ce"))


def _meetings(known: DataFrame, hubs: DataFrame) -> DataFrame:
    """Places to look at: those of large groups' members against the hubs of other classes, if windows of two functions
    bring the two documents together."""
    met = known.join(hubs, "gid").where("of_d != root")
    later = F.col("d") > F.col("e")
    met = met.select(F.greatest("d", "e").alias("m"), F.when(later, F.col("c")).otherwise(F.col("ce")).alias("cm"), F.least("d", "e").alias("r"), F.when(later, F.col("ce")).otherwise(F.col("c")).alias("cr"), F.expr("shiftleft(1, cast(k as int))").alias("k")).where("m != r")
    pairs = met.groupBy("m", "r").agg(F.bit_or("k").alias("ks"), F.collect_set(F.struct("cm", "cr")).alias("at")).where(F.bit_count("ks") > 1)
    return _cells(pairs.select("m", "r", F.explode("at").alias("x")).select("m", "r", "x.cm", "x.cr"))


def _several(known: DataFrame) -> DataFrame:
    """The windows (gid, d, c, of_d) of the groups with several classes."""
    several = known.groupBy("gid").agg(F.min("of_d").alias("lo"), F.max("of_d").alias("hi")).where("lo != hi").select("gid")
    return known.join(several, "gid")


def _sizes(known: DataFrame) -> DataFrame:
    """gid, top (its most frequent class), n (its windows) and outside (those of other classes)."""
    by_root = known.groupBy("gid", "of_d").agg(F.count("*").alias("n"))
    return by_root.groupBy("gid").agg(F.max(F.struct("n", "of_d")).alias("x"), F.sum("n").alias("n")).select("gid", F.col("x.of_d").alias("top"), "n", (F.col("n") - F.col("x.n")).alias("outside"))


def _outside(known: DataFrame) -> DataFrame:
    """The windows of the groups that hold more than ``OUTSIDE`` windows outside their largest class."""
    return known.join(_sizes(known).where(F.col("outside") > OUTSIDE).select("gid"), "gid", "left_semi")


def _remaining(known: DataFrame, dealt: DataFrame, groups: int) -> DataFrame:
    """m, r, first_word, similarity of links between windows of one large group whose documents are in different classes,
    as a table.

    One window stands for those of one class and group that are surrounded by the same shingles. The windows outside a
    group's most frequent class meet all of the group, in blocks of both, so that every two windows are in one class in the
    end or have been compared (see ``_across``). The surroundings travel packed, sorted by block, so that what many windows
    of a group share is sent about once by a group of documents."""
    ids, n = known.select(F.col("d").alias("doc_id")).distinct(), max(7, groups // WIDER)
    if ids.count() <= FEW:
        dealt = dealt.join(F.broadcast(ids), "doc_id", "left_semi")
    blocks = [F.ceil(F.col(x) / MEMBERS).cast("long").alias(name) for x, name in (("n", "of_all"), ("outside", "of_few"))]
    asked = known.join(_sizes(known).select("gid", "top", *blocks), "gid").select("gid", "d", "c", "of_d", (F.col("of_d") != F.col("top")).cast("long").alias("few"), "of_all", "of_few", F.pmod("d", F.lit(n)).alias("g"))
    dealt = dealt.withColumn("g", F.pmod("doc_id", F.lit(n)))
    sent = dealt.groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(_surroundings(n), "bucket long, n long, packed binary, rows binary")
    return written(sent.groupBy("bucket").applyInArrow(_blocks, "m long, r long, first_word long, similarity double"), "more")


_ROW = ("gid", "of_few", "of_all", "role", "few", "of_d", "d", "c", "lo", "hi")


def _surroundings(n: int):
    """The windows asked for in a group of documents as packed rows for ``n`` buckets of blocks, with the shingles around them
    (32 bits, in ``WIDE`` places) and the places that are inside the document."""

    def run(key: tuple, left: pa.Table, asked: pa.Table) -> pa.Table:
        ask = {x: asked[x].to_numpy() for x in ("gid", "d", "c", "of_d", "few", "of_all", "of_few")}
        by = np.argsort(ask["d"], kind="stable")
        ask = {x: v[by] for x, v in ask.items()}
        lo, hi = np.zeros(len(by), np.int64), np.zeros(len(by), np.int64)
        around, seen = np.zeros((len(by), WIDE), np.uint32), set()
        for doc_id, text in zip(left["doc_id"].to_pylist(), left["text"].to_pylist(), strict=True):
            i, j = np.searchsorted(ask["d"], [doc_id, doc_id + 1])
            if i == j or doc_id in seen:
                continue
            seen.add(doc_id)
            s, c = (shingles(text) >> U64(32)).astype(np.uint32), ask["c"][i:j]
            around[i:j] = np.lib.stride_tricks.sliding_window_view(np.pad(s, AROUND), WIDE)[c]
            lo[i:j], hi[i:j] = np.maximum(0, AROUND - c), np.minimum(WIDE, AROUND + len(s) - c)
        ask |= {"lo": lo, "hi": hi}
        one = _one_of_each(ask, around)
        ask, around = {x: v[one] for x, v in ask.items()}, around[one]
        # every window is in one block of all for each of the few, and one of the few in one block of these for each of all;
        # a group of one block is sent once, with both roles
        own = mix(ask["d"].astype(U64) * U64(0x9E3779B97F4A7C55) + ask["c"].astype(U64))
        few, alone = ask["few"] > 0, ask["of_all"] == 1
        at, rows = [], []
        for some, of, other, role in ((np.arange(len(own)), "of_all", "of_few", np.where(few & alone, 2, 0)), (np.nonzero(few & ~alone)[0], "of_few", "of_all", np.ones(len(own), np.int64))):
            times = ask[other][some]
            i = np.repeat(some, times)
            at.append(i)
            rows.append({of: (own[i] % ask[of][i].astype(U64)).astype(np.int64), other: np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times), "role": role[i]})
        at = np.concatenate(at)
        ask = {x: v[at] for x, v in ask.items()} | {x: np.concatenate([r[x] for r in rows]) for x in ("of_all", "of_few", "role")}
        bucket = (mix(ask["gid"].astype(U64) + mix((ask["of_few"] << 32 | ask["of_all"]).astype(U64))) % U64(n)).astype(np.int64)
        by = np.lexsort((ask["of_all"], ask["of_few"], ask["gid"], bucket))
        edges = np.nonzero(np.diff(bucket[by], prepend=-1, append=-1))[0] if len(by) else np.zeros(1, np.int64)
        cols: dict[str, list] = {"bucket": [], "n": [], "packed": [], "rows": []}
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            i = by[a:z]
            cols["bucket"].append(int(bucket[i[0]]))
            cols["n"].append(len(i))
            cols["packed"].append(pa.compress(around[at[i]].tobytes(), "zstd", asbytes=True))
            cols["rows"].append(pa.compress(planes(np.stack([ask[x][i] for x in _ROW])), "zstd", asbytes=True))
        return pa.table({"bucket": pa.array(cols["bucket"], pa.int64()), "n": pa.array(cols["n"], pa.int64()), "packed": pa.array(cols["packed"], pa.binary()), "rows": pa.array(cols["rows"], pa.binary())})

    return run


def _one_of_each(x: dict[str, np.ndarray], around: np.ndarray) -> np.ndarray:
    """One window, of the smallest document, for each group, class and surroundings."""
    factors, h = mix(np.arange(1, WIDE + 3, dtype=U64)), np.zeros(len(around), U64)
    with np.errstate(over="ignore"):
        for i in range(0, len(h), PIECE):
            h[i : i + PIECE] = (around[i : i + PIECE] * factors[:WIDE]).sum(axis=1, dtype=U64)
        h = mix(h + x["lo"].astype(U64) * factors[WIDE] + x["hi"].astype(U64) * factors[WIDE + 1])
    by = np.lexsort((x["c"], x["d"], h, x["of_d"], x["gid"]))
    new = np.ones(len(by), np.bool_)
    new[1:] = (h[by][1:] != h[by][:-1]) | (x["of_d"][by][1:] != x["of_d"][by][:-1]) | (x["gid"][by][1:] != x["gid"][by][:-1])
    return by[new]


def _blocks(key: tuple, group: pa.Table) -> pa.Table:
    rows: list[tuple] = []
    many, packed = group["n"].to_pylist(), group["packed"].to_pylist()
    told = [from_planes(pa.decompress(x, n * len(_ROW) * 8, "zstd", asbytes=True), np.int64).reshape(len(_ROW), n) for x, n in zip(group["rows"].to_pylist(), many, strict=True)]
    x = dict(zip(_ROW, np.concatenate(told, axis=1), strict=True))
    around = np.empty((sum(many), WIDE), np.uint32)
    for i, (end, n) in enumerate(zip(np.cumsum(many).tolist(), many, strict=True)):
        around[end - n : end] = np.frombuffer(pa.decompress(packed[i], n * WIDE * 4, "zstd"), np.uint32).reshape(n, WIDE)
    by = np.lexsort((x["of_all"], x["of_few"], x["gid"]))
    place = np.stack([x[y][by] for y in ("gid", "of_few", "of_all")])
    edges = np.nonzero(np.concatenate([[True], (place[:, 1:] != place[:, :-1]).any(axis=0), [True]]))[0]
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        i = by[a:z]
        block = {y: x[y][i] for y in _ROW}
        i = i[survivors(around[i], block["lo"], block["hi"], block["of_d"], block["role"])]
        if len(i):
            block = {y: x[y][i] for y in _ROW}
            # the roles of one window do not differ for those that it stands for
            one = _one_of_each(block | {"gid": block["role"]}, around[i])
            rows += _across({y: v[one] for y, v in block.items()}, around[i[one]])
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table({"m": pa.array(cols[0], pa.int64()), "r": pa.array(cols[1], pa.int64()), "first_word": pa.array(cols[2], pa.int64()), "similarity": pa.array(cols[3], pa.float64())})


def _may_pass(around: np.ndarray, slot: np.ndarray, outside: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which contexts hold T shingles in a row of which few enough different ones lack in ``common``: of a passage with i
    different shingles in common, i <= T, and its counterpart no more than i * (1 / SIMILARITY - 1) each."""

    def least(lacks: np.ndarray) -> np.ndarray:
        total = np.pad(np.cumsum(lacks, axis=1, dtype=np.int16), ((0, 0), (1, 0)))
        return (total[:, T:] - total[:, :-T]).min(axis=1)

    lacks = ~common[slot] | outside
    ok = least(lacks) <= MISSING
    # a closer look at the others, in which repeats count once
    for i in range(0, len(ok), PIECE >> 2):
        at = i + np.nonzero(~ok[i : i + (PIECE >> 2)])[0]
        earlier = _earlier(around[at])
        some = np.nonzero(least(lacks[at] & ((earlier < 0) | outside[at])) <= MISSING)[0]
        if not len(some):
            continue
        at, earlier = at[some], earlier[some]
        lack, out = lacks[at], outside[at]
        most = ((earlier < 0) & ~lack).sum(axis=1) * (1 / SIMILARITY - 1) + 1e-9
        lack &= ~out
        for start in range(WIDE - T + 1):
            run = slice(start, start + T)
            own = (lack[:, run] & (earlier[:, run] < start)).sum(axis=1)
            ok[at] |= ~out[:, start] & ~out[:, start + T - 1] & (own <= np.minimum(MISSING, most))
    return ok


def survivors(around: np.ndarray, lo: np.ndarray, hi: np.ndarray, classes: np.ndarray, role: np.ndarray) -> np.ndarray:
    """The windows of a block that may have a passage in common with one of another class.

    Of T shingles in a row a passage has no more than ``MISSING`` different ones for itself, and so has its counterpart: those
    that only windows of one class hold, or none on the other side, are of that kind. What is out leaves fewer shingles in
    common, so this repeats. Shingles meet in slots, where strangers that share one count as common: never too few stay."""
    labels = np.unique(classes, return_inverse=True)[1].astype(np.int32)
    n_slots = 1 << min(22, max(12, int(around.size * 2).bit_length()))
    slot = (around & np.uint32(n_slots - 1)).astype(np.int32)
    span = np.arange(WIDE)
    outside = (span < lo[:, None]) | (span >= hi[:, None])
    at = np.arange(len(around))
    while True:
        before = (role[at] > 0).sum()
        for asking in (True, False):
            label = np.full(n_slots, -1, np.int32)
            label[slot[at]] = labels[at, None]
            common = np.zeros(n_slots, np.bool_)
            common[slot[at][label[slot[at]] != labels[at, None]]] = True
            if not asking:
                theirs = np.zeros(n_slots, np.bool_)
                theirs[slot[at[role[at] > 0]]] = True
                common &= theirs
            mine = np.nonzero((role[at] > 0) == asking)[0]
            i = at[mine]
            at = np.delete(at, mine[~_may_pass(around[i], slot[i], outside[i], common)]) if len(i) else at
            if not (role[at] > 0).any():
                return at[:0]
        if (role[at] > 0).sum() > 0.9 * before:
            return at


def _probes(held: np.ndarray) -> np.ndarray:
    """Which shingles of some contexts are looked up, by how many windows hold them: of T in a row, at least as many as
    may be missing in a passage or, by words moved, beyond the ends of its counterpart, and one more, the rarest."""
    least = T - int(np.ceil(2 * T * SIMILARITY / (1 + SIMILARITY) - 1e-9)) + SLACK + 1
    rare = held <= RARE
    total = np.pad(np.cumsum(rare, axis=1, dtype=np.int16), ((0, 0), (1, 0)))
    row, start = np.nonzero(total[:, T:] - total[:, :-T] < least)
    out = rare.copy()
    for i in range(0, len(row), 1 << 14):
        r, at = row[i : i + (1 << 14), None], start[i : i + (1 << 14), None] + np.arange(T)
        best = np.argpartition(held[r, at], least - 1, axis=1)[:, :least]
        out[r, np.take_along_axis(at, best, axis=1)] = True
    return out


def _earlier(matrix: np.ndarray) -> np.ndarray:
    """The last place before each one that holds the same value, in every row; -1 for none."""
    order = np.argsort(matrix, axis=1, kind="stable")
    value = np.take_along_axis(matrix, order, axis=1)
    out = np.full(matrix.shape, -1, np.int16)
    r, i = np.nonzero(value[:, 1:] == value[:, :-1])
    out[r, order[r, i + 1]] = order[r, i]
    return out


def _extreme(x: np.ndarray, best) -> np.ndarray:
    """The least or greatest of each T places in a row."""
    wide, reach = x.shape[1] - T + 1, 1
    while 2 * reach <= T:
        x, reach = best(x[:, :-reach], x[:, reach:]), 2 * reach
    return best(x[:, :wide], x[:, T - reach : T - reach + wide])


def _across(group: dict[str, np.ndarray], around: np.ndarray) -> list[tuple[int, int, int, float]]:
    """m, r, first_word and similarity of links between the few and all windows of a block whose classes differ, as far as
    they join classes.

    Of T places in a row a passage and its counterpart agree in all but a few, up to SLACK, so one of any few more that
    are looked up is common to both: windows that share none of the rarest need no closer look. All others are verified, but
    for those that a link has brought into one class by then."""
    role, ids, c, few = group["role"], group["d"], group["c"], group["few"] > 0
    begin, end = group["lo"].astype(np.int16), group["hi"].astype(np.int16)
    before = AROUND - group["lo"]
    n, width = len(ids), WIDE
    parts = [x[a:z] for x, a, z in zip(around, begin.tolist(), end.tolist(), strict=True)]
    row, place = np.nonzero((np.arange(width) >= begin[:, None]) & (np.arange(width) < end[:, None]))
    raw = around[row, place]
    by = np.argsort(raw, kind="stable")
    value = np.zeros(len(by), np.int64)
    value[by[1:]] = np.cumsum(raw[by][1:] != raw[by][:-1])
    matrix = np.full((n, width), value.max(initial=-1) + 1, np.int32)
    matrix[row, place] = value
    # the places of every shingle in all windows of the block
    own = role[row] != 1
    by = by[own[by]]
    at_row, at_place = row[by], place[by]
    count = np.bincount(value[own], minlength=int(value.max(initial=-1)) + 2)
    first = np.cumsum(count) - count
    new = np.ones(len(by), np.bool_)  # and every window that holds it, once
    new[1:] = (at_row[1:] != at_row[:-1]) | (np.diff(value[by]) != 0)
    holder, once = at_row[new], np.cumsum(np.bincount(value[by][new] + 1, minlength=len(count) + 1))
    labels = np.unique(group["of_d"], return_inverse=True)[1]
    root, rows = labels.copy(), []
    asking, every = np.nonzero(role > 0)[0], np.nonzero(role != 1)[0]
    starts, earlier = np.arange(width - T + 1), np.zeros((n, width), np.int16)
    earlier[asking] = _earlier(matrix[asking])
    lookup = np.full(len(count), -1, np.int16)
    span = np.arange(width)

    def look(x: int, y: np.ndarray) -> None:
        if end[x] - begin[x] < T:
            return
        of = starts[begin[x] : end[x] - T + 1]
        held = slice(of[0], of[-1] + T)
        # how many shingles of the context each window holds, wherever they stand
        mine = matrix[x][begin[x] : end[x]][earlier[x][begin[x] : end[x]] < 0]
        least = T if len(mine) == end[x] - begin[x] else ((span >= of[:, None]) & (span < of[:, None] + T) & (earlier[x] < of[:, None])).sum(axis=1).min()
        many = once[mine + 1] - once[mine]
        at = np.repeat(once[mine] + many - np.cumsum(many), many) + np.arange(many.sum())
        y = y[np.bincount(holder[at], minlength=n)[y] >= SIMILARITY * least - 1e-3]
        if not len(y):
            return
        new = ((span[:, None] >= of) & (span[:, None] < of + T) & (earlier[x][:, None] < of)).astype(np.float32)
        own = new.sum(axis=0)
        needed = np.float32(SIMILARITY) * own - np.float32(1e-3)
        lookup[matrix[x][::-1]] = span[::-1]  # the first place of each shingle
        first_place = lookup[matrix[x]]
        lookup[-1] = -1
        for i in range(0, len(y), 1 << 12):
            some = y[i : i + (1 << 12)]
            some = some[(labels[some] != labels[x]) & (ids[some] != ids[x]) & (end[some] - begin[some] >= T)]
            if not len(some):
                continue
            near = lookup[matrix[some]]
            r, q = np.nonzero(near >= 0)
            found = np.full(near.shape, -1, np.int16)
            found[r[::-1], near[r, q][::-1]] = q[::-1]
            at = found[:, first_place]  # every place of the context has one, so the fillers find nothing
            # as in best_passage, but with the shingles of T places of a counterpart that may be longer: never too little
            common = (at >= 0).astype(np.float32) @ new
            near_by = np.nonzero((common >= needed).any(axis=1))[0]
            some, at, common = some[near_by], at[near_by][:, held], common[near_by]
            lo, hi = _extreme(np.where(at >= 0, at, np.int16(width)), np.minimum), _extreme(at, np.maximum) + np.int16(1)
            lo = np.where(hi - lo < T, np.clip(hi - T, begin[some][:, None], (end[some] - T)[:, None]), lo)
            if not len(some):
                continue
            before_it = _earlier(matrix[some])
            distinct = np.stack([(before_it[:, i : i + T] < i).sum(axis=1) for i in starts], axis=1).astype(np.float32)
            other = np.maximum(common, np.take_along_axis(distinct, np.minimum(lo, len(starts) - 1), axis=1))
            most = (common / (own + other - common)).max(axis=1, initial=0.0)
            for k in some[most >= SIMILARITY - 1e-6].tolist():
                if labels[k] == labels[x]:
                    continue
                m, r = (k, x) if ids[k] > ids[x] else (x, k)
                j, at_word = best_passage(parts[m], parts[r])
                if j < SIMILARITY:
                    j, at_word = best_passage(parts[r], parts[m])
                    at_word += before[m] - before[r]
                if j >= SIMILARITY:
                    rows.append((int(ids[m]), int(ids[r]), max(0, int(c[m] - before[m] + at_word)), float(j)))
                    labels[labels == max(labels[m], labels[r])] = min(labels[m], labels[r])
        lookup[matrix[x]] = -1

    for i in range(0, len(asking), 1 << 10):
        mine = asking[i : i + (1 << 10)]
        held = count[matrix[mine]]
        asked = _probes(held) & (held > 0)
        # where that meets about everything, everything is looked at
        whole = np.where(asked, held, 0).sum(axis=1) >= len(every)
        for x in mine[whole].tolist():
            look(x, every[~few[every] | (ids[x] > ids[every])])
        asked[whole] = False
        r, p = np.nonzero(asked)
        many = held[r, p]
        # a bounded number of meetings at a time
        cuts = np.nonzero(np.diff(np.cumsum(many) // (1 << 18), prepend=0))[0].tolist()
        for lo, hi in zip([0, *cuts], [*cuts, len(r)], strict=True):
            k = many[lo:hi]
            s = np.repeat(np.arange(lo, hi), k)
            at = first[matrix[mine[r[s]], p[s]]] + np.arange(len(s)) - np.repeat(np.cumsum(k) - k, k)
            x, y = mine[r[s]], at_row[at]
            ok = (np.abs(at_place[at] - p[s]) <= SLACK) & (root[x] != root[y]) & (~few[y] | (ids[x] > ids[y]))
            pair = np.unique(x[ok] * n + y[ok])
            x, y = pair // n, pair % n
            for z in np.split(np.arange(len(pair)), np.nonzero(np.diff(x))[0] + 1):
                if len(z):
                    look(int(x[z[0]]), y[z])
    return rows


def near_duplicate_passages(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest id of the documents joined by shared passages), n_links (other documents with which a
    passage of the document has been verified), first_word and similarity of the document's best link to a smaller document
    (null without one)."""
    found, parts = links(docs)
    pairs = found.groupBy("m", "r").agg(F.max(F.struct("similarity", (-F.col("first_word")).alias("n"))).alias("best"))
    ends = pairs.select(F.col("m").alias("doc_id"), "best").unionByName(pairs.select(F.col("r").alias("doc_id"), F.lit(None).cast("struct<similarity:double,n:bigint>").alias("best")))
    count = ends.groupBy("doc_id").agg(F.count("*").alias("n_links"), F.max("best").alias("best"))
    ids = texts(docs).select("doc_id")
    out = ids.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(count, "doc_id", "left")
    return out.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), (-F.col("best.n")).alias("first_word"), F.col("best.similarity").alias("similarity"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_passages(table(spark, sf_dir, "documents"))
