import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from corvid.llm import bpe, huffman, packing
from corvid.llm.common import Workspace
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer


def reference(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def test_round_trip_equals_tiktoken(spark, odd, none, sf):
    own = ranks()
    for df in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        want = Counter()
        for d, t in texts(df):
            ids = own.encode_ordinary(t)
            want[d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
        assert Counter(r[:4] for r in map(tuple, bpe.round_trip(df).collect())) == want
    assert bpe.round_trip(none).count() == 0


def test_encode_offsets_and_decode(odd):
    got = bpe.encode(odd)
    own = ranks()
    back = Counter(map(tuple, bpe.decode(got).collect()))
    assert back == Counter(texts(odd))
    for r in got.collect():
        assert len(r["ids"]) == len(r["starts"]) == len(r["ends"])
        assert all(a <= b for a, b in zip(r["starts"], r["ends"]))
    assert sorted(map(list, (r["ids"] for r in got.collect()))) == sorted(own.encode_ordinary(t) for _, t in texts(odd))


def own_offsets(text, ids):
    """The code points of each id's bytes, found one byte at a time."""
    owner = [k for k, c in enumerate(text) for _ in c.encode()]
    table, at, out = bpe.byte_table(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i in ids:
        end = at + len(table[i])
        out.append((owner[at], owner[end - 1] + 1, at > 0 and owner[at] == owner[at - 1]))
        at = end
    assert at == len(owner)
    return out


def test_round_trip_offsets_equal_brute_force(odd, none):
    own, want = ranks(), Counter()
    for d, t in texts(odd):
        starts, ends, split = zip(*own_offsets(t, own.encode_ordinary(t))) if t else ((), (), ())
        want[d, sum(split), zlib.crc32(np.array(starts + ends, "<u4").tobytes())] += 1
    assert Counter(map(tuple, bpe.round_trip(odd).select("doc_id", "n_split", "offsets_crc32").collect())) == want
    assert bpe.encode(none).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n'é́字😀𐍈A1"), st.characters(codec="utf-8")), max_size=40))
def test_offsets_of_any_text(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, starts, ends, split = bpe.with_offsets(text, path)
    want = own_offsets(text, reference("byte_bpe_50k.json")(text))
    assert list(zip(starts.tolist(), ends.tolist())) == [x[:2] for x in want] and split == sum(x[2] for x in want)
    assert bpe.decode_bytes(ids.tolist(), path).decode() == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n'sdt.,é ́A1"), st.characters(codec="utf-8")), max_size=40))
def test_chunks_equal_library(text):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        from corvid.llm.vocab import encoder

        path = public_tokenizers.path(name)
        assert np.frombuffer(encoder(path).encode(text), "<u4").tolist() == reference(name)(text)


def test_columns_equal_library_and_look_up_each_chunk_once(odd, monkeypatch):
    from corvid.llm import vocab

    texts = [r["text"] or "" for r in odd.collect()] + ["Don't, don't; Straße\u00a0ﬁ İI\u0307 ΣΑΣ ΟΔΟΣ, H\u0331a é$$$ don't's!' <|endoftext|> a_b c--d x²; 3.14\n\nThe the, the.", "a" * 300 + " b"] * 3
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        for side, remembered in ((1 << 23, 1_000_000), (40, 6)):
            monkeypatch.setattr(vocab, "SIDE_BY_SIDE", side), monkeypatch.setattr(vocab, "HELD_CHUNKS", remembered)
            own = vocab.Encoder(public_tokenizers.path(name))
            parts = list(own.columns(pa.array(texts, pa.string()), 1))
            ids, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [reference(name)(t) + [1] for t in texts]
    own, asked = vocab.Encoder(public_tokenizers.path("word_bpe_49k.json")), []
    word = own._word
    monkeypatch.setattr(own, "_word", lambda c: asked.append(c) or word(c))
    monkeypatch.setattr(vocab, "HELD_CHUNKS", 1_000_000)
    for _ in range(3):
        list(own.columns(pa.array(["Le chat noir... chien!", "le chat"] * 5), 1))
    assert sorted(asked) == ["Le", "chat", "chien", "le", "noir"]


def test_files_round_trip(spark, odd, none, sf):
    ids = reference("word_bpe_49k.json")
    for df in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        path = Workspace(spark).path()
        huffman.write(df, path)
        rows = huffman.digest(huffman.read(spark, path)).collect()
        want = [(d, np.array(ids(t) + [1], "<u4").tobytes()) for d, t in texts(df)]
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == Counter((d, len(b) // 4, zlib.crc32(b)) for d, b in want)
        rows.sort(key=lambda r: r["start"])
        assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1]]
        assert [-1 if r["doc_id"] is None else r["doc_id"] for r in rows] == sorted(-1 if d is None else d for d, _ in want)
    path = Workspace(spark).path()
    huffman.write(none, path)
    assert huffman.read(spark, path).count() == 0


def test_code_lengths():
    rng = np.random.default_rng(1)
    for n, bits in ((1, 4), (2, 4), (16, 4), (300, 10), (1000, 16)):
        counts = (rng.zipf(1.3, n) % 100_000 + 1).astype(np.int64)
        lengths = huffman.limited_lengths(counts, bits)
        assert lengths.max() <= bits
        assert (2.0 ** -lengths).sum() <= 1
        ids = rng.choice(n, 5000, p=counts / counts.sum())
        code = huffman.Code(lengths)
        data, marks = code.encode(ids)
        assert (code.decode(data, marks, len(ids)) == ids).all()
    assert huffman.limited_lengths(np.array([1, 1, 2, 4]), 3).tolist() == [3, 3, 2, 1]
    assert huffman.limited_lengths(np.array([1, 1, 2, 4]), 2).tolist() == [2, 2, 2, 2]


def test_fill_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(200):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 30, 5)}
        room = int(rng.integers(0, 60))
        got = packing.fill(counts, room)
        assert all(n <= counts[k] for k, n in got.items())
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1)}
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= room)


def test_packing(spark, odd, none, sf):
    ids = reference("byte_bpe_50k.json")
    for df in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = packing.pack(df).collect()
        by = defaultdict(list)
        for r in rows:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        assert sorted(by) == list(range(len(by)))
        padding = 0
        for v in by.values():
            at = 0
            for offset, length in sorted(v):
                assert offset == at
                at += length
            assert at <= 2048
            padding += 0 if at & (at - 1) == 0 else 2048 - at
        want = Counter()
        for d, t in texts(df):
            x = np.array(ids(t) + [1], "<u4")
            for a in range(0, len(x), 2048):
                want[d, a, len(x[a : a + 2048]), zlib.crc32(x[a : a + 2048].tobytes()), len(x)] += 1
        assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
        assert padding < 2048 * 2
    assert packing.pack(none).count() == 0


def test_blocks_of_very_many_empty_texts(spark):
    """A block holds as many documents as it has ids: the work on each must not grow with those before it."""
    n = huffman.BLOCK_IDS + 40_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("").alias("text")).coalesce(1)
    blocks = huffman.tokenized_blocks(df, public_tokenizers.path(huffman.VOCABULARY))
    assert blocks.agg(F.sum(F.size("doc_ids"))).first()[0] == n
