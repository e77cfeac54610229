"""Byte-level BPE encoding with offsets, and decoding, over Arrow batches."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from corvid.llm.common import lean, text_rows
from corvid.llm.vocab import byte_characters, encoder

VOCABULARY = "byte_bpe_50k.json"
_TABLES: dict[str, list[bytes]] = {}
_LENGTHS: dict[str, np.ndarray] = {}


def byte_table(path: str) -> list[bytes]:
    """The bytes of each id: its characters, each turned back into the byte it stands for."""
    if path not in _TABLES:
        back = {c: b for b, c in enumerate(byte_characters())}
        tokenizer = encoder(path).tokenizer
        special = {i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
        table = [b""] * tokenizer.get_vocab_size()
        for token, i in tokenizer.get_vocab().items():
            table[i] = token.encode() if i in special else bytes(back[c] for c in token)
        _TABLES[path] = table
    return _TABLES[path]


def byte_lengths(path: str) -> np.ndarray:
    """How many bytes each id stands for."""
    if path not in _LENGTHS:
        _LENGTHS[path] = np.array([len(b) for b in byte_table(path)], np.int64)
    return _LENGTHS[path]


def decode_bytes(ids, path: str) -> bytes:
    """The bytes of a sequence of ids. A character whose bytes are split among ids comes out whole once all of them are joined."""
    return b"".join(map(byte_table(path).__getitem__, ids))


def with_offsets(text: str, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The ids of a text; the first code point that each covers, and the one after its last; how many ids begin within a character.

    Each id stands for as many bytes as its entry in the byte table, and a code point begins at
    each byte that continues no other. A character split among several ids is in the offsets of each.
    """
    ids = np.frombuffer(encoder(path).encode(text), "<u4")
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    leads = data & 0xC0 != 0x80
    character = np.cumsum(leads, dtype=np.int32)
    last = np.cumsum(byte_lengths(path)[ids])
    first = np.concatenate([[0], last[:-1]])[: len(ids)]
    assert len(ids) == 0 or last[-1] == len(data), "the ids stand for other bytes than the text has"
    return ids, character[first] - 1, character[last - 1], int((~leads[first]).sum())


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, starts array<int>, ends array<int>): ids and the code points that each covers.

    A character split among several ids is in the offsets of each. Null and empty texts
    give empty arrays; repeated rows give a row each.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        for batch in batches:
            ids, starts, ends = [], [], []
            for text in batch.column("text"):
                i, a, b, _ = with_offsets(text.as_py(), path)
                ids.append(i.astype(np.int32))
                starts.append(a)
                ends.append(b)
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, lists) for x in (ids, starts, ends))], ["doc_id", "ids", "starts", "ends"])

    return text_rows(docs).select("doc_id", "text").mapInArrow(lean(run, encodes=True), "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(ids: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids array<int>); bytes that are no UTF-8 become U+FFFD, null ids an empty text."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        for batch in batches:
            texts = [decode_bytes(x.as_py() or (), path).decode("utf-8", "replace") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(lean(run, encodes=True), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_split, offsets_crc32) of every whole text, encoded with offsets and decoded again.

    n_split counts the ids that begin within a character; offsets_crc32 is of all starts, then
    all ends, as little-endian unsigned 32-bit integers. Null is the empty text; repeated rows give a row each.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split", "offsets_crc32"]

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text"):
                ids, starts, ends, split = with_offsets(text.as_py(), path)
                ids = ids.tolist()
                digests = (hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), decode_bytes(ids, path)))
                out.append((len(ids), *digests, split, zlib.crc32(ends.astype("<u4"), zlib.crc32(starts.astype("<u4")))))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    return text_rows(docs).select("doc_id", "text").mapInArrow(lean(run, encodes=True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long, offsets_crc32 long")
