"""Packing of token sequences by minimum bin slack over the histogram of piece lengths."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import Workspace, lean, text_rows
from corvid.llm.vocab import encoder

VOCABULARY, END, CAPACITY = "byte_bpe_50k.json", 1, 2048
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, each at most as often as counted, whose sum comes closest to room from below.

    A bitset holds the sums that can be reached. Each length adds shifted copies of it, in
    batches of 1, 2, 4, ... pieces; the bitsets before each batch tell which batches a sum
    was made of.
    """
    reached, steps, full = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, batch = min(counts[length], room // length), 1
        while left:
            n = min(batch, left)
            steps.append((reached, length, n))
            reached |= (reached << (length * n)) & full
            left, batch = left - n, batch * 2
        if reached >> room & 1:
            break
    at, out = reached.bit_length() - 1, {}
    for before, length, n in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + n
            at -= length * n
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (pieces by length) and how many sequences follow each, until every piece has its place.

    Each pattern starts with the longest piece left, is filled with the least slack, and is
    repeated while the counts last. Each uses up a length's count or halves it, so there are
    few patterns however many pieces there are.
    """
    left, out = {k: n for k, n in histogram.items() if n}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        pattern = fill({k: n for k, n in rest.items() if n}, capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((pattern, times))
    return out


def places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, pieces a sequence, first sequence, offset of the first piece), one for each pattern that uses it."""
    rows, used, sequence = {}, {}, 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            rows.setdefault(length, []).append((used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids and END, cut into pieces of the capacity and a rest; part and rank number the pieces of a length in each partition."""
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        coder, part, ranks = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = coder.encode(text.as_py()) + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    rows.append((doc_id.as_py(), start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, part, ranks[length]))
                    ranks[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 7)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"])

    return text_rows(docs).select("doc_id", "text").mapInArrow(lean(run, encodes=True), f"{PIECE}, part long, rank long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece of every document.

    Only the histogram of piece lengths, of at most as many rows as the capacity, comes to
    the driver, and only the plan made of it goes back. A piece's rank among those of its
    length gives its place. An empty table gives no rows; an empty or null text is END alone;
    repeated rows are packed each.
    """
    spark = docs.sparkSession
    pieces = Workspace(spark).put(token_pieces(docs, path or public_tokenizers.path(VOCABULARY), capacity), "pieces")
    counted = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    at = places(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["part", "length"]).select(*PIECE.replace(" long", "").split(", "), (F.col("rank") + F.col("before")).alias("rank"))

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                own = np.flatnonzero(length == k)
                rows = at[int(k)]
                row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                q, r = np.divmod(rank[own] - row[:, 0], row[:, 1])
                sequence[own], offset[own] = row[:, 2] + q, row[:, 3] + r * k
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(lean(run, encodes=True), f"{PIECE}, sequence_id long, offset long")
