"""Hashes of words, and what they cost."""

import random
import time

import numpy as np
import pyarrow as pa
from corvid.llm import words


def by_bytes(c):
    """The hash of each word of a chunk, with some numbers of 64 bits held for each byte."""
    begins = np.repeat(c.starts, c.ends - c.starts)
    at = np.arange(len(begins)) - np.repeat(np.cumsum(c.ends - c.starts) - (c.ends - c.starts), c.ends - c.starts)
    scale = words.powers(words._BASE, int(at.max(initial=0)) + 1)[at] * (c.data[begins + at].astype(np.uint64) + np.uint64(1))
    sums = np.add.reduceat(scale, np.flatnonzero(at == 0)) if len(at) else np.zeros(0, np.uint64)
    return words.mix(sums + (c.ends - c.starts).astype(np.uint64) * words._A)


def test_hashes_of_words_of_any_bytes_and_length():
    """Words around the length of a step, many steps of short words, and every byte but white space."""
    rng = random.Random(4)
    step = words._STEP
    texts = [b"", b" ", b"a" * (step - 1) + b" b", b"a " + b"b" * step + b" c", b"x" * (step + 1), b"y" * (2 * step + 5) + b"\n z", bytes(range(256)), b"no", b"gap"]
    texts += [bytes(rng.choices(range(256), k=rng.randrange(300))) for _ in range(2000)] + [b"\xff" * 40_000 + b" "] * 5 + [b"ab c" * 50_000]
    column = pa.Array.from_buffers(pa.string(), len(texts), pa.array(texts, pa.binary()).buffers())
    found = list(words.chunks(column))
    assert [bytes(c.data[s:e]) for c in found for s, e in zip(c.starts, c.ends)] == [w for t in texts for w in t.split()]
    assert len(found) == 1 and found[0].hashes.tolist() == by_bytes(found[0]).tolist()


def test_a_chunk_is_hashed_without_numbers_for_each_byte():
    """op1 reads every text three times, mostly for these hashes: well under the CPU time that sums byte by byte take."""
    rng = random.Random(5)
    known = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(1, 12))) for _ in range(3000)]
    column = pa.array([" ".join(rng.choices(known, k=280_000))])

    def least(run):
        took = []
        for _ in range(5):
            begun = time.process_time()
            run()
            took.append(time.process_time() - begun)
        return min(took)

    (chunk,) = words.chunks(column)
    assert least(lambda: list(words.chunks(column))) < 0.75 * least(lambda: by_bytes(chunk))
