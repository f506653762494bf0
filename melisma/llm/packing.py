"""Packing by concatenation and cutting.

Every partition tokenises its documents once and keeps a running total; the totals of the partitions, one number for
each, are summed to give every partition its global offset; then the sequences are fixed windows over the global
positions. A document that crosses a window's bound leaves one boundary record (piece) in each window it touches, so
only the very last sequence is shorter than the window.

Tokens are kept in between as a table of 16- or 32-bit ids, so that texts are tokenised once and no row is shuffled.

Defined results: null text has only the separator; repeated rows are packed as often as they occur; an empty table
gives no rows; a text of any length is cut into as many pieces as it needs.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.llm.common import Out, rows_of, table, texts, written

WINDOW, SEPARATOR, VOCABULARY = 1024, 0, "byte_bpe_50k"
_loaded: dict = {}


def encoder(name: str = VOCABULARY):
    """text -> token ids by the public vocabulary ``name``.

    The rank file holds the same vocabulary and splits by the same pattern as the tokenizers file and gives the same
    ids several times faster; a text that holds the string of a special token goes to the tokenizers library."""
    if name not in _loaded:
        import base64

        import public_tokenizers
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        full = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        special = [t.content for t in full.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if any(s in text for s in special):
                return np.array(full.encode(text, add_special_tokens=False).ids, np.uint32)
            return np.array(fast.encode_ordinary(text), np.uint32)

        _loaded[name] = encode
    return _loaded[name]


def tokenised(docs: DataFrame, vocabulary: str = VOCABULARY, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, part (the partition), start (tokens before it in the partition), n, ids (little-endian, 16 or 32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, total = encoder(vocabulary), TaskContext.get().partitionId(), 0
        out = Out(pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("wide", pa.bool_()), ("ids", pa.binary())]))
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            ids = np.append(encode(text), np.uint32(separator))
            wide = bool(ids.max() >= 1 << 16)
            out.add(doc_id, part, total, len(ids), wide, ids.astype("<u4" if wide else "<u2").tobytes())
            total += len(ids)
            if out.full():
                yield out.take()
        yield out.take()

    return texts(docs).mapInArrow(run, "doc_id long, part long, start long, n long, wide boolean, ids binary")


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, separator: int = SEPARATOR) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (binary, little-endian 32 bits), doc_tokens, sequence_id, offset."""
    kept = written(tokenised(docs, vocabulary, separator), "tokens")
    # one number for each partition of the input comes to the driver, nothing that grows with the rows in it
    totals = dict(kept.groupBy("part").agg(F.max(F.col("start") + F.col("n"))).collect())
    base, at = {}, 0
    for part in sorted(totals):
        base[part] = at
        at += totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
        out = Out(pa.schema(fields))
        for doc_id, part, start, n, wide, raw in rows_of(batches, "doc_id", "part", "start", "n", "wide", "ids"):
            ids = np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4")
            begin, done = base[part] + start, 0
            while done < n:
                sequence, offset = divmod(begin + done, window)
                size = min(window - offset, n - done)
                out.add(doc_id, done, size, ids[done : done + size].tobytes(), n, sequence, offset)
                done += size
                if out.full():
                    yield out.take()
        yield out.take()

    return kept.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))
