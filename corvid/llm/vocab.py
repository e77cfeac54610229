"""Text to token ids by the tokenizers library, with each white-space chunk encoded once per worker.

Neither vocabulary merges across white space. A text in which single spaces and single line
feeds separate the chunks is cut there, and each distinct chunk is encoded once and then
looked up. Any other text goes to the library whole, so ids are the same either way.

Where a chunk's ids do not depend on what precedes it, a column of texts is split and its
chunks are numbered by Arrow; each distinct one is looked up once, and ids are gathered by number.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Chunks that a worker remembers per table, and the longest of them.
REMEMBERED, LONGEST = 500_000, 48
#: Chunks and ids that the table of numbered chunks holds before it begins anew, runs of symbols that are remembered, and bytes of text that are encoded side by side.
HELD_CHUNKS, HELD_IDS, TAILS, SIDE_BY_SIDE = 1_000_000, 1 << 22, 10_000, 1 << 23
#: What ends a word within a chunk and makes a token run of its own; an apostrophe may begin a contraction.
_SYMBOLS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
_PUNCTUATION = set(".,;:!?|)")


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


_TO_CHARACTER = dict(enumerate(byte_characters()))


def _packed(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


class _Chunks(dict):
    """Chunk to packed ids; lead is what precedes the chunk in the text."""

    def __init__(self, encoder: "Encoder", lead: str):
        super().__init__({"": b""})
        self.encoder, self.lead = encoder, lead

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > 1 and chunk[-1] in _PUNCTUATION and chunk[:-1].isalpha():
            out = self[chunk[:-1]] + self.encoder.alone[chunk[-1]]
        else:
            out = self.encoder.chunk(chunk, self.lead)
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
                self[""] = b""
            self[chunk] = out
        return out


class _Numbered:
    """Chunks by number, their ids end to end; number 0 is the end id."""

    def __init__(self, end: int):
        self.number: dict[str, int] = {}
        self.begin, self.size, self.ids = np.zeros(1, np.int64), np.ones(1, np.int64), np.array([end], np.uint32)

    def ids_of(self, chunk: str) -> list[int] | None:
        k = self.number.get(chunk)
        return None if k is None else self.ids[self.begin[k] : self.begin[k] + self.size[k]].tolist()

    def add(self, chunks: list[str], size: list[int], ids: list[int]) -> None:
        size = np.array(size, np.int64)
        self.number.update(zip(chunks, range(len(self.size), len(self.size) + len(chunks)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.array(ids, np.uint32)])

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks in turn, and where each one's end."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        return self.ids[np.arange(size.sum()) + np.repeat(self.begin[numbers] - (ends - size), size)], ends


class Encoder:
    """encode(text): the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.words = bool(self.model.end_of_word_suffix)
        self.alone = {c: self.whole(c) for c in _PUNCTUATION}
        self.head, self.spaced = _Chunks(self, ""), _Chunks(self, " ")
        self.line_feed = b"" if self.words else self.whole("\n")
        self.numbered: _Numbered | None = None
        self.tails: dict[str, list[int]] = {}

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def chunk(self, chunk: str, lead: str) -> bytes:
        if chunk.isalpha():
            if self.words:
                plain = "".join(c.lower() for c in unicodedata.normalize("NFC", chunk)) if not chunk.isascii() else chunk.lower()
                if not plain.isalpha():
                    return self.whole(chunk)
            else:
                plain = lead + chunk
            mapped = plain.encode("utf-8").decode("latin-1").translate(_TO_CHARACTER)
            return _packed([t.id for t in self.model.tokenize(mapped)])
        return self.whole(chunk if self.words else lead + chunk)

    def encode(self, text: str) -> bytes:
        if self.words:
            return b"".join(map(self.head.__getitem__, text.replace("\n", " ").split(" ")))
        if " ".join(text.split()) != text.replace("\n", " "):
            return self.whole(text)
        head, spaced, out = self.head, self.spaced.__getitem__, []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out += (self.line_feed, head[first])
            out += map(spaced, rest)
        return b"".join(out[1:])


    def columns(self, texts: pa.Array, end: int):
        """(ids, sizes) of stretches of a column of texts without nulls, the end id after each text; sizes count it."""
        filled = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.diff(filled // SIDE_BY_SIDE)) + 1 if len(texts) else []
        for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True):
            own = texts[a:b]
            if not self.words:
                packed = [self.encode(t) + _packed([end]) for t in own.to_pylist()]
                yield np.frombuffer(b"".join(packed), "<u4"), np.fromiter(map(len, packed), np.int64, len(packed)) // 4
                continue
            chunks = pc.split_pattern(pc.replace_substring(own, "\n", " "), " ")
            coded = chunks.flatten().dictionary_encode()
            distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            after = np.cumsum(chunks.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            numbers = self._numbers(distinct, end)[coded.indices.to_numpy()]
            ids, ends = self.numbered.gather(np.insert(numbers, after, 0))
            yield ids, np.diff(ends[after + np.arange(len(after))], prepend=0)

    def _numbers(self, distinct: list[str], end: int) -> np.ndarray:
        """The chunks' numbers; those not known yet are encoded and numbered."""
        known = self.numbered
        if known is None or known.ids[0] != end or len(known.ids) > HELD_IDS or len(known.number) + len(distinct) > HELD_CHUNKS:
            known = self.numbered = _Numbered(end)
        fresh, sizes, ids = [c for c in distinct if c not in known.number], [], []
        for c in fresh:
            before = len(ids)
            word = c.rstrip(_SYMBOLS)
            if word.isalpha():
                ids += known.ids_of(word) or self._word(word)
                if len(word) < len(c):
                    ids += self._symbols(c[len(word) :])
            elif c:
                ids += self.tokenizer.encode(c, add_special_tokens=False).ids
            sizes.append(len(ids) - before)
        known.add(fresh, sizes, ids)
        return np.fromiter(map(known.number.__getitem__, distinct), np.int64, len(distinct))

    def _word(self, word: str) -> list[int]:
        """The ids of a word of letters, as chunk() has them."""
        if word.isascii():
            return [t.id for t in self.model.tokenize(word.lower())]
        plain = unicodedata.normalize("NFC", word)
        plain = "".join(c.lower() for c in plain) if "Σ" in plain else plain.lower()  # a whole word's last sigma is another one
        if not plain.isalpha():
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        return [t.id for t in self.model.tokenize(plain.encode("utf-8").decode("latin-1").translate(_TO_CHARACTER))]

    def _symbols(self, tail: str) -> list[int]:
        if tail not in self.tails:
            if len(self.tails) >= TAILS or len(tail) > LONGEST:
                return self.tokenizer.encode(tail, add_special_tokens=False).ids
            self.tails[tail] = self.tokenizer.encode(tail, add_special_tokens=False).ids
        return self.tails[tail]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Drops this process's encoders with the chunks they remember."""
    for own in _ENCODERS.values():
        own.head, own.spaced = None, None
    _ENCODERS.clear()
