"""SimHash near-duplicates by covering locality-sensitive hashing.

Every fingerprint position gets one of the 7 non-zero vectors of three bits; table v (again one of 7) masks the
positions whose vector has an odd product with v. For any two positions some v is orthogonal to both vectors, so two
fingerprints that differ in at most two bits agree under some mask: no pair within the radius is missed.

Equal fingerprints are one node. In a bucket of up to ``SMALL`` fingerprints the pairs are compared; a larger bucket
is resolved without pairs: two fingerprints are within two bits of each other exactly if they share a value that lies
within one bit of both, so each is linked to the 65 values around it, and a value has at most 65 fingerprints near it.
Hence neither many copies nor a crowded bucket makes the work grow with the square of a group.

Texts of similarity 0.8 lie 5 to 14 bits apart (measured on the test tables), beyond any radius that covering can serve
with a practical number of tables. Where whole groups of such copies are wanted, ``similar`` finds them by minimum hashes
(one permutation, ``BINS`` bins, bands of ``BAND``), collapses equal texts first, and verifies candidates by the exact
Jaccard similarity of their shingles; ``groups`` joins these links with those of the fingerprints.

Defined results: null or empty text has fingerprint zero and links like any other; fewer than three words are one
shingle; repeated rows give repeated output rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from melisma.llm.common import Out, blobs, mix, rows_of, table, texts, words, written
from melisma.llm.components import components

RADIUS, SEED, SHINGLE, SMALL = 2, 42, 3, 32
#: Bits are dealt over the vectors 1..7 in turn; a stride of 3 keeps neighbours apart.
_VECTORS = [1 + (3 * i) % 7 for i in range(64)]
MASKS = [sum(1 << i for i, u in enumerate(_VECTORS) if (u & v).bit_count() % 2 == 0) for v in range(1, 8)]
BLOCK = 1 << 16
BINS, BAND = 128, 4
#: Bounds of a block of documents that are compared in full, and shingles that are counted at once.
MEMBERS, BYTES, COLUMNS = 1024, 2 << 20, 4096


def shingles(text: str, k: int) -> np.ndarray:
    """64-bit hashes of a text's shingles of k words; fewer words are one shingle."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    n = max(1, len(w) - k + 1)
    with np.errstate(over="ignore"):
        s = h[:n].copy()
        for i in range(1, min(k, len(w))):
            s = s * np.uint64(0x9E3779B97F4A7C55) + h[i : i + n]
        return mix(s)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text: a bit is set where over half of the shingles' hashes have it."""
    w = words(text)
    if not w:
        return 0
    line = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w))
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    k = min(shingle, len(w))
    begin, end = start[: len(w) - k + 1].tolist(), (start + size)[k - 1 :].tolist()
    h, view, n = xxhash.xxh64_intdigest, memoryview(line), len(begin)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        part = np.fromiter((h(view[a:b], SEED) for a, b in zip(begin[i : i + BLOCK], end[i : i + BLOCK], strict=True)), np.uint64, min(BLOCK, n - i))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())]))
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            out.add(doc_id, _signed(fingerprint(text, shingle)))
            if out.full():
                yield out.take()
        yield out.take()

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def links(nodes: DataFrame) -> DataFrame:
    """Edges a, b between fingerprints ``fp`` (distinct) that join exactly those within the radius, directly or through
    shared neighbours. Hub values only serve to connect; each is represented by its smallest fingerprint."""
    spread = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in MASKS])).alias("t", "masked"))
    size = spread.groupBy("t", "masked").agg(F.count("*").alias("n"), F.min("fp").alias("one"), F.max("fp").alias("two")).where("n > 1")
    pair = size.where("n = 2").select(F.col("one").alias("a"), F.col("two").alias("b"))
    # few buckets hold more than two fingerprints; theirs are fetched by a join that spreads a hot bucket
    more = spread.join(size.where("n > 2").select("t", "masked", "n"), ["t", "masked"])
    few = more.where(F.col("n") <= SMALL).groupBy("t", "masked").agg(F.sort_array(F.collect_set("fp")).alias("fps"))
    few = few.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b")).where("a < b")
    near = pair.unionByName(few).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    many = more.where(F.col("n") > SMALL).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    hubs = many.select("fp", F.explode(flips).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("hub"))
    star = hubs.groupBy("hub").agg(F.array_sort(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)
    star = star.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 64)).alias("b"))
    return near.unionByName(star).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that can be reached over links."""
    marked = written(fingerprints(docs, shingle), "simhash")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    parts = components(links(nodes.select("fp")))
    named = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp")


def _signature(s: np.ndarray) -> np.ndarray:
    """One-permutation minimum hashes; an empty bin takes its value from the next full one."""
    out = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    if not len(s):
        return out
    h = mix(s)
    by = np.sort(h)
    which = (by >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.concatenate([[True], which[1:] != which[:-1]])
    out[which[first]] = by[first]
    full = which[first]
    source = np.searchsorted(full, np.arange(BINS))
    far = np.where(source < len(full), full[np.minimum(source, len(full) - 1)], full[0])
    return mix(out[far] + ((far - np.arange(BINS)) % BINS).astype(np.uint64))


def _sketched(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("content", pa.int64()), ("bands", pa.list_(pa.int64()))]))
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            s = shingles(text, shingle)
            content = int(np.bitwise_xor.reduce(mix(s + np.arange(len(s), dtype=np.uint64)))) if len(s) else 0
            bands: list[int] = []
            if len(s):
                sig = _signature(s).reshape(-1, BAND)
                with np.errstate(over="ignore"):
                    h = np.arange(len(sig), dtype=np.uint64)
                    for i in range(BAND):
                        h = mix(h + sig[:, i])
                bands = h.view(np.int64).tolist()
            out.add(doc_id, _signed(fingerprint(text, shingle)), _signed(content), bands)
            if out.full():
                yield out.take()
        yield out.take()

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(pa.schema([("doc_id", pa.int64()), ("s", pa.binary())]))
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            out.add(doc_id, np.unique(shingles(text, shingle)).tobytes())
            if out.full():
                yield out.take()
        yield out.take()

    return run


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        for a, b, x, y in rows_of(batches, "a", "b", "sa", "sb"):
            u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if min(len(u), len(v)) < least * max(len(u), len(v)):
                continue
            common = len(np.intersect1d(u, v, assume_unique=True))
            if common >= least * (len(u) + len(v) - common):
                out.add(a, b)
                if out.full():
                    yield out.take()
        yield out.take()

    return run


def _across(least: float):
    """Links between the few and all documents of a block whose roots differ, one for each pair of roots."""

    def run(group: pa.Table) -> pa.Table:
        few = group["few"].to_numpy(zero_copy_only=False).astype(np.bool_)
        ids, roots = group["doc_id"].to_numpy(), group["root"].to_numpy()
        sets = blobs(group["s"], np.uint64)
        sides = []
        for side in (np.nonzero(few)[0], np.nonzero(~few)[0]):
            size = np.array([len(sets[i]) for i in side], np.int64)
            value = np.concatenate([sets[i] for i in side] or [np.zeros(0, np.uint64)])
            by = np.argsort(value, kind="stable")
            sides.append((side, size, value[by], np.repeat(np.arange(len(side)), size)[by]))
        (x, nx, vx, rx), (y, ny, vy, ry) = sides
        shared = np.intersect1d(vx, vy)
        common = np.zeros((len(x), len(y)), np.float32)
        for i in range(0, len(shared), COLUMNS):
            part = shared[i : i + COLUMNS]
            held = []
            for v, r, n in ((vx, rx, len(x)), (vy, ry, len(y))):
                lo, hi = np.searchsorted(v, part[0]), np.searchsorted(v, part[-1], side="right")
                at = np.searchsorted(part, v[lo:hi])
                ok = part[at] == v[lo:hi]
                m = np.zeros((n, len(part)), np.float32)
                m[r[lo:hi][ok], at[ok]] = 1
                held.append(m)
            common += held[0] @ held[1].T
        hit = (common >= least * ((nx[:, None] + ny[None, :]) - common.astype(np.float64))) & (roots[x][:, None] != roots[y][None, :])
        i, j = np.nonzero(hit)
        i, j = x[i], y[j]
        one = np.unique(np.stack([roots[i], roots[j]], axis=1), axis=0, return_index=True)[1] if len(i) else i
        return pa.table({"a": np.minimum(ids[i[one]], ids[j[one]]), "b": np.maximum(ids[i[one]], ids[j[one]])})

    return run


def _remaining(band: DataFrame, size: DataFrame, sets: DataFrame, parts: DataFrame, least: float) -> DataFrame:
    """Links a, b between documents of one band group that the links so far leave in different components ``parts``.

    The documents outside a group's most frequent component meet all of the group, in blocks of both that are bounded
    by documents and by bytes; groups of up to three documents have been compared already."""
    width = sets.select("doc_id", F.octet_length("s").alias("bytes"))
    met = band.join(size.where("n > 3").select("i", "h"), ["i", "h"]).join(width, "doc_id")
    met = met.join(parts.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    met = written(met, "crowds")
    by_root = met.groupBy("i", "h", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    group = by_root.groupBy("i", "h").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root", "bytes")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("roots > 1")

    def blocks(n, size):
        return F.greatest(F.lit(1), F.ceil(n / MEMBERS), F.ceil(size / BYTES)).cast("int")

    group = group.select("i", "h", F.col("top.root").alias("top"), blocks(F.col("n"), F.col("bytes")).alias("of_all"), blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("of_few"))
    dealt = met.join(group, ["i", "h"])

    def deal(x: DataFrame, few: bool, own: str, other: str) -> DataFrame:
        mine, others = F.pmod(F.xxhash64("doc_id"), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return x.select("i", "h", "doc_id", "root", F.lit(few).alias("few"), mine.alias(own), others.alias(other))

    both = deal(dealt.where("root != top"), True, "of_few", "of_all").unionByName(deal(dealt, False, "of_all", "of_few"))
    return both.join(sets, "doc_id").groupBy("i", "h", "of_few", "of_all").applyInArrow(_across(least), "a long, b long")


def similar(docs: DataFrame, sketched: DataFrame, known: DataFrame, least: float, shingle: int) -> DataFrame:
    """node, root over the links ``known`` and those between documents of similarity ``least`` or more, one document
    standing for equal texts.

    In a band's group every document is first compared with the smallest one and with the one before it in two orders.
    Whatever these links leave apart is then compared in full, so that every two documents of a group are in one
    component or have been compared."""
    one = sketched.where(F.size("bands") > 0).groupBy("content").agg(F.min(F.struct("doc_id", "bands")).alias("x")).select("x.doc_id", "x.bands")
    band = one.select("doc_id", F.posexplode("bands").alias("i", "h"))
    size = band.groupBy("i", "h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    # the previous document in the order of the ids, and in that of a hash, among those of a slice of the group: a hot
    # group is dealt over as many slices as it needs
    met = band.join(size, ["i", "h"]).withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), (F.col("n") / 256).cast("long"))))
    slices = Window.partitionBy("i", "h", "slice")
    met = met.select("doc_id", "first", F.lag("doc_id").over(slices.orderBy("doc_id")).alias("p"), F.lag("doc_id").over(slices.orderBy(F.xxhash64("doc_id"))).alias("q"))
    pairs = met.select("doc_id", F.explode(F.array("first", "p", "q")).alias("o")).where("o IS NOT NULL AND o != doc_id")
    pairs = written(pairs.select(F.least("doc_id", "o").alias("a"), F.greatest("doc_id", "o").alias("b")).distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = written(texts(docs).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_sets(shingle), "doc_id long, s binary"), "sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    parts = written(components(known.unionByName(both.mapInArrow(_alike(least), "a long, b long"))), "parts")
    rest = _remaining(band, size, sets, parts, least)
    return components(parts.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(rest))


def groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, group_id (smallest id of its group): documents joined by fingerprints within the radius, by equal words,
    or by a similarity of their shingles of ``similarity`` or more. Texts without words are groups of their own."""
    sketched = written(texts(docs).mapInArrow(_sketched(shingle), "doc_id long, fp long, content long, bands array<long>"), "sketches")
    nodes = sketched.where(F.size("bands") > 0).groupBy("fp").agg(F.min("doc_id").alias("first"))
    near = links(nodes.select("fp"))
    a, b = nodes.select(F.col("fp").alias("a"), F.col("first").alias("x")), nodes.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    by_print = near.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = sketched.where(F.size("bands") > 0).join(nodes, "fp").where("doc_id != first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    equal = sketched.where(F.size("bands") > 0).groupBy("content").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1")
    equal = sketched.join(equal, "content").select("a", F.col("doc_id").alias("b"))
    parts = similar(docs, sketched, by_print.unionByName(same).unionByName(equal), similarity, shingle)
    return sketched.select("doc_id").distinct().join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("group_id"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
