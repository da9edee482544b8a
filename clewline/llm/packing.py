"""Concatenate-and-cut packing of tokenised documents."""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import materialise
from .registry import query, release, table
from .vocab import encode_bytes

VOCABULARY = "byte_bpe_50k.json"
WINDOW = 2048
END_ID = 1


def tokenise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One row per document: (doc_id, part, seq, local_start, n_tokens, ids).

    ``ids`` holds little-endian unsigned 32-bit ids with ``end_id`` last; ``local_start`` is the token count of the
    documents before it in its partition ``part``. A null text counts as empty, so every document has one token at
    least; repeated and null document ids are kept as rows of their own.
    """
    id_type = dict(docs.dtypes)[doc_id]

    def run(batches):
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            texts, names = batch.column(1), batch.column(0)
            first = 0
            while first < len(texts):  # at most about 8 MB of text at a time
                size, last = 0, first
                ids: list[bytes] = []
                counts: list[int] = []
                while last < len(texts) and size < 8 << 20:
                    value = texts[last].as_py() or ""
                    got = encode_bytes(vocabulary, value)
                    counts.append(len(got) + 1)
                    ids.append(got.astype("<u4").tobytes() + end_id.to_bytes(4, "little"))
                    size += len(value)
                    last += 1
                n = np.array(counts, dtype=np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [names.slice(first, last - first), pa.array([part] * len(n), pa.int32()), pa.array(np.arange(seq, seq + len(n)), pa.int64()),
                     pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "seq", "local_start", "n_tokens", "ids"])
                seq += len(n)
                first = last
            release()

    chosen = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id {id_type}, part int, seq bigint, local_start bigint, n_tokens bigint, ids binary")


def concatenate_and_cut(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces of the endless token stream that ``tokens`` (a written table of :func:`tokenise`) makes, cut every ``window`` ids.

    Pass one sums the tokens of each partition; a running sum over these totals (one short row per partition) gives each
    partition's place in the stream, and with it each document's. Pass two cuts documents at multiples of ``window``.
    Only the last sequence can be short. Columns: doc_id, start, length, ids, doc_tokens, sequence_id, offset.
    """
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    # One short row per partition: its size is bounded by their number, not by the text.
    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", "n_tokens", "ids", (F.col("base") + F.col("local_start")).alias("at"))
    id_type = dict(tokens.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            at = batch.column(3).to_numpy()
            n = batch.column(1).to_numpy()
            per = (at + n - 1) // window - at // window + 1
            row = np.repeat(np.arange(len(n)), per)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
            sequence = at[row] // window + nth
            begin = np.maximum(sequence * window, at[row])
            end = np.minimum((sequence + 1) * window, (at + n)[row])
            start = begin - at[row]
            length = end - begin
            for low in range(0, len(row), 4096):
                span = slice(low, low + 4096)
                ids = [batch.column(2)[int(r)].as_buffer().slice(int(s) * 4, int(k) * 4).to_pybytes() for r, s, k in zip(row[span], start[span], length[span])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[span])), pa.array(start[span]), pa.array(length[span]), pa.array(ids, pa.binary()),
                     pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(n[row[span]]), pa.array(sequence[span]), pa.array((begin % window)[span])],
                    names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    schema = f"doc_id {id_type}, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return placed.mapInArrow(run, schema)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Documents to pieces of sequences. The token table is written once, so a lost executor cannot change the order."""
    return concatenate_and_cut(materialise(tokenise(docs, doc_id, text, vocabulary, end_id), "tokens"), window)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op8_pack_concatenate_cut")
def op8(spark, folder):
    return digest(pack(table(spark, folder, "documents")))
