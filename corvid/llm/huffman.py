"""Token ids in files: canonical length-limited Huffman codes in blocks that decode on their own."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.common import RID, Workspace, lean, partitions, text_rows
from corvid.llm.vocab import encoder

VOCABULARY, END = "word_bpe_49k.json", 1
#: Longest code in bits (more only if there are too many symbols for it), ids per block, ids per checkpoint.
MAX_BITS, BLOCK_IDS, CHECKPOINT_IDS = 16, 1 << 18, 256


def limited_lengths(counts: np.ndarray, bits: int) -> np.ndarray:
    """Optimal code lengths of at most so many bits, by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    assert n <= 1 << bits, "too many symbols for codes of this length"
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    row, levels = leaves, [np.ones(n, bool)]
    for _ in range(bits - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([leaves, pairs])
        at = np.argsort(merged, kind="stable")
        row = merged[at]
        levels.append(at < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(levels):
        own = int(leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes by symbol, and the symbols in code order: by length, then by id."""
    symbols = np.flatnonzero(lengths)
    symbols = symbols[np.lexsort((symbols, lengths[symbols]))]
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for n in np.unique(lengths[symbols]):
        own = symbols[lengths[symbols] == n]
        code <<= int(n) - last
        codes[own] = np.arange(code, code + len(own), dtype=np.uint64)
        code, last = code + len(own), int(n)
    return codes, symbols


class Code:
    """Encoding and table-driven decoding with given code lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes, symbols = canonical(self.lengths)
        self.bits = int(self.lengths.max(initial=1))
        span = np.left_shift(1, self.bits - self.lengths[symbols])
        self.symbol, self.length = np.zeros(1 << self.bits, np.int32), np.ones(1 << self.bits, np.int64)
        self.symbol[: span.sum()] = np.repeat(symbols, span)
        self.length[: span.sum()] = np.repeat(self.lengths[symbols], span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, and the bit at which every CHECKPOINT_IDS-th id begins."""
        length = self.lengths[ids]
        ends = np.cumsum(length)
        begins = ends - length
        total = int(ends[-1]) if len(ids) else 0
        placed = self.codes[ids] << (64 - (begins & 31) - length).astype(np.uint64)
        slot, size = begins >> 5, (total >> 5) + 2
        words = np.bincount(slot, (placed >> np.uint64(32)).astype(np.float64), size) + np.bincount(slot + 1, (placed & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
        return words.astype(">u4").tobytes()[: (total + 7) // 8], begins[::CHECKPOINT_IDS].copy()

    def decode(self, data: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """All stretches between checkpoints advance together, an id each step, each by a table look-up of the next bits."""
        if not n:
            return np.zeros(0, np.int32)
        b = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
        window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        at, last = checkpoints.astype(np.int64).copy(), len(data) * 8
        out = np.empty((CHECKPOINT_IDS, len(at)), np.int32)
        drop = np.uint32(32 - self.bits)
        for k in range(min(CHECKPOINT_IDS, n)):
            v = (window[at >> 3] << (at & 7).astype(np.uint32)) >> drop
            out[k] = self.symbol[v]
            at += self.length[v]
            np.minimum(at, last, out=at)
        return out.T.reshape(-1)[:n]


def tokenized_blocks(docs: DataFrame, path: str) -> DataFrame:
    """Blocks of whole documents' ids in ascending doc_id order (nulls first), END after each; part and block number them, start counts the ids of the part before the block."""
    spark = docs.sparkSession
    ordered = text_rows(docs).repartitionByRange(partitions(spark), "doc_id", RID).sortWithinPartitions("doc_id", RID)

    def run(batches):
        coder, part, block, start = encoder(path), TaskContext.get().partitionId(), 0, 0
        held, sizes, ids, total = [], [], [], 0
        kind = "<u2" if coder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

        def flush():
            nonlocal block, start, held, sizes, ids, total
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([held], pa.list_(pa.int64())), pa.array([np.concatenate(sizes)], pa.list_(pa.int64())), pa.array([np.concatenate(ids).tobytes()], pa.binary())],
                ["part", "block", "start", "doc_ids", "sizes", "ids"],
            )
            block, start, held, sizes, ids, total = block + 1, start + total, [], [], [], 0
            return out

        for batch in batches:
            doc_ids, at = batch.column("doc_id").to_pylist(), 0
            for own, size in coder.columns(batch.column("text"), END):
                ends, a, done = np.cumsum(size), 0, 0
                while a < len(size):  # a block takes whole documents until it is full
                    b = min(int(np.searchsorted(ends, done + BLOCK_IDS - total)) + 1, len(size))
                    upto = int(ends[b - 1])
                    held += doc_ids[at + a : at + b]
                    sizes.append(size[a:b])
                    ids.append(own[done:upto].astype(kind))
                    total, a, done = total + upto - done, b, upto
                    if total >= BLOCK_IDS:
                        yield flush()
                at += len(size)
        if held:
            yield flush()

    return ordered.select("doc_id", "text").mapInArrow(lean(run, encodes=True), "part int, block int, start long, doc_ids array<long>, sizes array<long>, ids binary")


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def id_counts(blocks: DataFrame) -> np.ndarray:
    """How often each id occurs: summed per partition, then by Spark. As many numbers as the vocabulary has ids reach the driver."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw, sizes in zip(batch.column("ids"), batch.column("sizes"), strict=True):
                own = np.bincount(_ids(raw.as_py(), sum(sizes.as_py())))
                if len(own) > len(total):
                    total, own = own, total
                total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    rows = blocks.select("sizes", "ids").mapInArrow(lean(run, encodes=True), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def write(docs: DataFrame, path: str, vocabulary: str | None = None, max_bits: int = MAX_BITS) -> None:
    """Writes the ids of all documents: {path}/blocks has a row per block, {path}/code the code lengths and the ids in each part.

    A block row has its documents and their sizes, the bits, and the bit offset of every
    CHECKPOINT_IDS-th id. It needs nothing but the code to be decoded. An empty table
    gives files without rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    blocks = work.put(tokenized_blocks(docs, vocabulary or public_tokenizers.path(VOCABULARY)), "ids")
    counts = id_counts(blocks)
    lengths = limited_lengths(counts, max(max_bits, math.ceil(math.log2(max(2, np.count_nonzero(counts))))))
    packed = lengths.astype(np.uint8).tobytes()

    def run(batches):
        code = Code(np.frombuffer(packed, np.uint8))
        for batch in batches:
            n, bits, marks = [], [], []
            for raw, sizes in zip(batch.column("ids"), batch.column("sizes"), strict=True):
                n.append(sum(sizes.as_py()))
                data, begins = code.encode(_ids(raw.as_py(), n[-1]))
                bits.append(data)
                marks.append(begins.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.array(marks, pa.binary())], ["part", "block", "start", "doc_ids", "sizes", "n", "bits", "checkpoints"])

    blocks.mapInArrow(lean(run, encodes=True), "part int, block int, start long, doc_ids array<long>, sizes array<long>, n long, bits binary, checkpoints binary").write.parquet(f"{path}/blocks")
    totals = {r["part"]: r["n"] for r in spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("n")).collect()}
    parts = [totals.get(k, 0) for k in range(max(totals, default=-1) + 1)]
    spark.createDataFrame([(bytearray(packed), parts)], "lengths binary, parts array<long>").coalesce(1).write.parquet(f"{path}/code")
    work.drop(blocks)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) from files of write(): ids are little-endian unsigned 32-bit integers, start counts the ids of all documents before."""
    head = spark.read.parquet(f"{path}/code").first()
    packed, before = bytes(head["lengths"]), np.concatenate([[0], np.cumsum(head["parts"], dtype=np.int64)]).tolist()

    def run(batches):
        code = Code(np.frombuffer(packed, np.uint8))
        for batch in batches:
            for row in batch.to_pylist():
                ids = code.decode(row["bits"], np.frombuffer(row["checkpoints"], "<u8"), row["n"]).astype("<u4")
                ends = np.cumsum(row["sizes"])
                begins = ends - row["sizes"]
                data = ids.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(begins + row["start"] + before[row["part"]], pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array([data[4 * a : 4 * b] for a, b in zip(begins, ends, strict=True)], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return spark.read.parquet(f"{path}/blocks").mapInArrow(lean(run, encodes=True), "doc_id long, start long, n_tokens long, ids binary")


def digest(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of read()'s rows."""
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
