"""Repeated byte strings by suffix arrays of shards.

A string of LENGTH bytes that occurs twice has the same anchor each time: the leftmost
smallest hash of its GRAM-byte grams. So the places that may repeat are grouped by their
anchor's gram, each with the bytes around it; equal surroundings fall together before any
text moves. Shards of these contexts are sorted by Larsson-Sadakane refinement, common
prefixes come from Kasai's walk, and where one gram fills several shards, their sorted
strings are merged by binary search.

The same is done for strings of words: a text is then the string of its words' digests, of 8
bytes each, and places, lengths and grams count words. A unit is 1 byte or the 8 of a word.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import RID, Workspace, give_back, lean, retexted, settled, text_rows, whole_rows

#: Bytes of a string and of an anchor's gram, contexts of a gram in one shard, contexts a shard.
LENGTH, GRAM, PER_GRAM, PER_SHARD = 400, 100, 2000, 2500
#: Words of a string and of an anchor's gram, and bytes of a word's digest.
WORDS, WORD_GRAM, WORD = 50, 12, 8
#: Stretches around an anchor by which contexts that can't share a string are told before they are sorted.
STEPS = 8
#: Bytes that one numpy pass looks at.
STRETCH = 1 << 22
#: Lower bits of a hash that give way to its place in a stretch.
PLACE_BITS = 23
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_PAD = b"\0" * (LENGTH + 64)


def units(data: bytes, unit: int) -> bytes:
    """A text's bytes, or the digests of its words, which white space of ASCII parts."""
    return data if unit == 1 else b"".join(map(xxhash.xxh3_64_digest, data.split()))


def words64(data: bytes, unit: int = 1) -> np.ndarray:
    """The 8 bytes from each unit on, as a big-endian number: it orders as the bytes do."""
    n = max(0, (len(data) - 8) // unit + 1)
    return np.ndarray((n,), ">u8", data, strides=(unit,)).astype(np.uint64) if n else np.zeros(0, np.uint64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = a * _A
    z ^= z >> np.uint64(29)
    z += b
    z *= _B
    z ^= z >> np.uint64(32)
    return z


def gram_hashes(data: bytes, gram: int, unit: int = 1) -> np.ndarray:
    """A hash of the gram units from each place on."""
    h, size = words64(data, unit) * _B, 8 // unit
    h ^= h >> np.uint64(31)
    while size < gram:
        step = min(size, gram - size)
        h, size = _mix(h[:-step], h[step:]), size + step
    return h


def anchor_runs(data: bytes, length: int, gram: int, unit: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, number of starts and the gram's hash for each run of starts with one anchor.

    The anchor is the leftmost gram whose hash has the smallest upper bits. They are as many in
    a text of any length, so a string has the same anchor wherever it stands.
    """
    h = gram_hashes(data, gram, unit)
    span = length - gram + 1
    if len(h) < span:
        none = np.zeros(0, np.int64)
        return none, none, none
    assert len(h) < 1 << PLACE_BITS, "a stretch has more places than the lower bits can number"
    low = np.uint64(PLACE_BITS)
    m = (h >> low << low) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size < span:
        step = min(size, span - size)
        m, size = np.minimum(m[:-step], m[step:]), size + step
    first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    at = (m[first] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    return first, np.diff(np.append(first, len(m))), h[at].view(np.int64)


def anchors(rows: DataFrame, kinds: tuple) -> DataFrame:
    """(RID, s0, n, f, c): runs of n starts from unit s0 on that share an anchor; its gram's hash f, whose last bit tells words from bytes, and a 128-bit digest c of all their units."""

    def run(batches):
        for batch in batches:
            for rid, text in zip(batch.column(RID), batch.column("text"), strict=True):
                whole = text.as_py().encode("utf-8", "surrogatepass")
                for unit, length, gram in kinds:
                    data = units(whole, unit)
                    starts = len(data) // unit - length + 1
                    for a in range(0, max(0, starts), STRETCH):
                        part = data[a * unit : (a + STRETCH + length - 1) * unit]
                        first, n, f = anchor_runs(part, length, gram, unit)
                        c = [xxhash.xxh3_128_digest(part[s * unit : (s + k + length - 1) * unit]) for s, k in zip(first.tolist(), n.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), rid.as_py()), pa.int64()), pa.array(first + a), pa.array(n), pa.array(marked(f, unit)), pa.array(c, pa.binary())], [RID, "s0", "n", "f", "c"])

    def gathered(batches):
        held, size = [], 0
        for b in run(batches):
            held.append(b)
            size += b.num_rows
            if size > 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return rows.select(RID, "text").mapInArrow(lean(gathered), f"{RID} long, s0 long, n long, f long, c binary")


def marked(f: np.ndarray, unit: int) -> np.ndarray:
    """Hashes of grams with the last bit set for words alone, so that bytes and words have none in common."""
    return f & ~np.int64(1) | np.int64(unit == WORD)


def refine(rank: np.ndarray, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """One Larsson-Sadakane step: places that share a rank with others are sorted within it by their keys.

    A rank is the index at which its group begins in sorted order, so groups split in place
    and places already alone keep theirs. Returns the places that still share one.
    """
    order = np.argsort(keys)
    k, p = keys[order], at[order]
    g = rank[p]
    here = np.arange(len(p))
    head = np.concatenate([[True], k[1:] != k[:-1]])
    group = np.concatenate([[True], g[1:] != g[:-1]])
    head |= group
    rank[p] = g + np.maximum.accumulate(np.where(head, here, 0)) - np.maximum.accumulate(np.where(group, here, 0))
    alone = head & np.concatenate([head[1:], [True]])
    return p[~alone]


def suffix_order(data: bytes, starts: np.ndarray, length: int, unit: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of the length units from each on, and whether each has the same ones as the start before.

    Ranks by 8 bytes come from one sort. A rank and those that follow it at one and two
    times the depth, packed in a word, triple the depth; only places that still share a
    rank go on. The last step joins two ranks that overlap to the length, for the starts alone.
    """
    n = len(data) // unit
    assert n < 1 << 21, "a shard's places must fit 21 bits"
    w = words64(data + _PAD, unit)
    rank = np.zeros(len(w) + 2 * length, np.int64)
    first = np.argsort(w[:n], kind="stable")
    k = w[first]
    head = np.concatenate([[True], k[1:] != k[:-1]])[:n]
    rank[first] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1
    at, depth = first[~(head & np.concatenate([head[1:], [True]])[:n])], 8 // unit

    def packed(p: np.ndarray, *steps: int) -> np.ndarray:
        out = rank[p].astype(np.uint64)
        for s in steps:
            out = out << np.uint64(21) | rank[p + s].astype(np.uint64)
        return out

    while depth * 3 <= length and len(at):
        at, depth = refine(rank, at, packed(at, depth, 2 * depth)), depth * 3
    keys = packed(starts, *([length - depth] if depth * 2 >= length else [depth, length - depth]))
    order = np.argsort(keys, kind="stable")
    return starts[order], np.concatenate([[False], keys[order[1:]] == keys[order[:-1]]])[: len(order)]


def common_prefixes(data: bytes, order: np.ndarray, same: np.ndarray, base: np.ndarray, n: np.ndarray, length: int, unit: int = 1) -> np.ndarray:
    """Units, up to length, that each start in sorted order shares with the one before.

    Kasai's walk along each context's starts: the next start shares at least one unit less
    with its predecessor than this one, so comparing goes on from there. All contexts walk
    at once. A walk begins anew where the predecessor ends its context, and after a start that
    is the same as its predecessor, for which of the two comes first says nothing about what
    follows. 8 bytes are compared at a time.
    """
    w = words64(data + _PAD, unit)
    rank = np.full(len(data) // unit + 1, -1)
    rank[order] = np.arange(len(order))
    ends = np.zeros(len(data) // unit + 1, bool)
    ends[base + n - 1] = True
    out, h, cut = np.zeros(len(order), np.int64), np.zeros(len(base), np.int64), np.ones(len(base), bool)
    for k in range(int(n.max(initial=0))):
        live = np.flatnonzero(n > k)
        s = base[live] + k
        r = rank[s]
        p = order[r - 1]
        d = np.where(cut[live] | (r == 0), 0, np.maximum(h[live] - 1, 0))
        tie = same[r]
        d[tie] = length
        going = np.flatnonzero((r > 0) & ~tie)
        while len(going):
            x = w[s[going] + d[going]] ^ w[p[going] + d[going]]
            alike = x == 0
            part = going[~alike]
            x = x[~alike]
            d[part] += sum((x >> np.uint64(b) == 0).astype(np.int64) for b in range(8, 64, 8)) // unit
            going = going[alike]
            d[going] += 8 // unit
            going = going[d[going] < length]
        d = np.minimum(d, length)
        h[live], cut[live] = d, ends[p] | (r == 0) | tie
        out[r] = d
    return out


_RANGES = f"{RID} long, a long, b long, f long, sub int, slot int, digests binary, rids binary, starts binary, alone binary"
_COLUMNS = [c.split()[0] for c in _RANGES.split(", ")]


def _joined(frames: list[pd.DataFrame]) -> pd.DataFrame:
    """The frames' rows; empty frames have no types, and with one of them large hashes would turn into floating point."""
    frames = [x for x in frames if len(x)]
    return pd.concat(frames) if frames else pd.DataFrame({c: [] for c in _COLUMNS})


def shard_repeats(pdf: pd.DataFrame, length: int, unit: int = 1) -> pd.DataFrame:
    """Of a shard's contexts: ranges a to b of starts whose string occurs again; and, where the gram has several shards (m), the distinct strings' digests in sorted order, packed with a start of each, in m slots by digest."""
    base = np.concatenate([[0], np.cumsum([len(x) // unit for x in pdf.ctx])[:-1]]).astype(np.int64)
    n, data = pdf.n.to_numpy(), b"".join(pdf.ctx)
    starts = np.repeat(base, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    order, same = suffix_order(data, starts, length, unit)
    lcp = common_prefixes(data, order, same, base, n, length, unit)
    cls = np.cumsum(lcp < length) - 1
    at = np.searchsorted(base, order, side="right") - 1
    weight = np.bincount(cls, pdf.cnt.to_numpy()[at])
    rid, first = pdf[RID].to_numpy(), pdf.s0.to_numpy()
    out = []
    own = np.sort(order[(weight[cls] > 1) & (pdf.cnt.to_numpy()[at] == 1)])
    if len(own):
        where = np.searchsorted(base, own, side="right") - 1
        head = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 1) | (np.diff(where) != 0)]))
        a = own[head] - base[where[head]] + first[where[head]]
        size = np.diff(np.append(head, len(own)))
        out.append(pd.DataFrame({RID: rid[where[head]], "a": a, "b": a + size - 1, "f": int(unit == WORD), "sub": 0, "slot": 0}))
    m, f, sub = (pdf[c].to_numpy() for c in ("m", "f", "sub"))
    lead = np.flatnonzero((lcp < length) & (m[at] > 1))
    if len(lead):
        s, where = order[lead], at[lead]
        digests = np.array([xxhash.xxh3_128_digest(data[x * unit : (x + length) * unit]) for x in s.tolist()], "S16")
        slot = (np.frombuffer(digests.tobytes(), "<u8")[::2] % m[where].astype(np.uint64)).astype(int)
        alone = (weight[cls[lead]] == 1).astype(np.uint8)
        place = s - base[where] + first[where]
        by = np.lexsort((digests, slot, sub[where], f[where]))
        keys = np.stack([f[where], sub[where], slot])[:, by]
        for own in np.split(by, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1):
            k = own[0]
            out.append(pd.DataFrame([{RID: 0, "a": 0, "b": 0, "f": f[where[k]], "sub": sub[where[k]], "slot": slot[k], "digests": digests[own].tobytes(), "rids": rid[where[own]].tobytes(), "starts": place[own].tobytes(), "alone": alone[own].tobytes()}]))
    return _joined(out).reindex(columns=_COLUMNS)


def merge_shards(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one gram's strings in several shards: the starts that are alone in theirs and found in another, each shard's sorted digests looked up in the others' by binary search."""
    lists = [np.frombuffer(d, "S16") for d in pdf.digests]
    hits = []
    for k, own in enumerate(lists):
        found = np.zeros(len(own), bool)
        for j, other in enumerate(lists):
            if j != k:
                found |= other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own
        found &= np.frombuffer(pdf.alone.iloc[k], np.uint8) == 1
        start = np.frombuffer(pdf.starts.iloc[k], np.int64)[found]
        hits.append(pd.DataFrame({RID: np.frombuffer(pdf.rids.iloc[k], np.int64)[found], "a": start, "b": start, "f": pdf.f.iloc[k]}))
    return pd.concat(hits)


def _unit():
    return F.when(F.col("f").bitwiseAND(1) == 1, WORD).otherwise(1).alias("unit")


def repeats(docs: DataFrame, work: Workspace, kinds: tuple = ((1, LENGTH, GRAM),)) -> DataFrame:
    """(RID, unit, a, b): ranges of starts, in units, of strings that start somewhere else, too; kinds are a unit, the units of a string and those of a gram, one for each unit."""
    rows = text_rows(docs)
    every = work.put(anchors(rows, kinds), "anchors")
    shared = every.groupBy("f").count().where("count > 1").select("f")
    found = work.put(every.join(shared.hint("shuffle_hash"), "f", "left_semi"), "shared")
    work.drop(every)
    # Equal surroundings have one n, and the firsts of a group are of one row: plain numbers, which are aggregated without a sort.
    contexts = found.groupBy("f", "c").agg(F.count("*").alias("cnt"), *(F.first(x).alias(x) for x in (RID, "s0", "n")))
    unlike = contexts.groupBy("f").agg(F.count("*").alias("kinds"))
    contexts = work.put(contexts.join(unlike, "f").select("f", "c", "cnt", "kinds", RID, "s0", "n"), "contexts")
    copied = found.join(contexts.where("cnt > 1").select("f", "c"), ["f", "c"], "left_semi").select(RID, _unit(), F.col("s0").alias("a"), (F.col("s0") + F.col("n") - 1).alias("b"))
    unlike = contexts.where("kinds > 1").withColumn("m", F.ceil(F.col("kinds") / PER_GRAM).cast("int"))
    unlike = unlike.withColumn("sub", F.pmod(F.xxhash64("c"), F.col("m")).cast("int")).select(RID, F.struct("s0", "n", "f", "cnt", "m", "sub").alias("s"))
    total = unlike.count()
    if not total:
        return copied
    sizes = {unit: length for unit, length, _ in kinds}
    listed = unlike.groupBy(RID).agg(F.collect_list("s").alias("s"))

    def cut(batches):
        for batch in batches:
            for row in batch.to_pylist():
                whole, s = row["text"].encode("utf-8", "surrogatepass"), row["s"]
                of = [WORD if x["f"] & 1 else 1 for x in s]
                data = {unit: units(whole, unit) for unit in set(of)}
                ctx = [data[unit][x["s0"] * unit : (x["s0"] + x["n"] + sizes[unit] - 1) * unit] for x, unit in zip(s, of, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[RID]] * len(s), pa.int64()), *(pa.array([x[k] for x in s], pa.int64()) for k in ("s0", "n", "f", "cnt")), *(pa.array([x[k] for x in s], pa.int32()) for k in ("m", "sub")), pa.array(ctx, pa.binary())],
                    [RID, "s0", "n", "f", "cnt", "m", "sub", "ctx"],
                )

    cut_out = rows.join(listed, RID).select(RID, "text", "s").mapInArrow(lean(cut), f"{RID} long, s0 long, n long, f long, cnt long, m int, sub int, ctx binary")
    shards = max(1, -(-total // PER_SHARD))
    sharded = cut_out.withColumn("shard", F.pmod(F.xxhash64("f", "sub"), F.lit(shards)).cast("int"))
    sorted_ = work.put(sharded.groupBy("shard").applyInPandas(lambda pdf: _of_kinds(pdf, kinds), _RANGES), "sorted")
    alone = sorted_.where("digests is null").select(RID, _unit(), "a", "b")
    several = sorted_.where("digests is not null")
    merged = several.groupBy("f", "slot").applyInPandas(merge_shards, f"{RID} long, a long, b long, f long").select(RID, _unit(), "a", "b")
    return copied.unionByName(alone).unionByName(merged)


def may_repeat(pdf: pd.DataFrame, length: int, gram: int, unit: int = 1) -> np.ndarray:
    """Whether a context may share a string with another of its gram; sure to be so where the gram has several shards.

    Two places of a string have the anchor at one place within it. Whatever units of the string lie
    before the gram, of STEPS + 1 stretches around the gram, each of nearly the whole string's
    length, one lies within it: so contexts that share none of them with another share no string.
    """
    size = pdf.ctx.str.len().to_numpy() // unit
    base = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    data = b"".join(pdf.ctx)
    h = marked(gram_hashes(data, gram, unit).view(np.int64), unit)
    own = np.flatnonzero(h == np.repeat(pdf.f.to_numpy(), size)[: len(h)])
    at = own[np.searchsorted(own, base)]  # a context's anchor is the first place that has its gram
    out, free = pdf.m.to_numpy() > 1, length - gram
    step = max(1, free // STEPS)
    for before in range(0, free + 1, step):
        a, b = at - before, at + gram + max(0, free - before - step + 1)
        whole = np.flatnonzero((a >= base) & (b <= base + size))
        keys = np.array([xxhash.xxh3_64_intdigest(data[x * unit : y * unit]) for x, y in zip(a[whole].tolist(), b[whole].tolist(), strict=True)], np.uint64)
        _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        out[whole[count[inverse] > 1]] = True
    return out


def _of_kinds(pdf: pd.DataFrame, kinds: tuple) -> pd.DataFrame:
    """A shard's bytes and its words, each by itself."""
    out = [_in_parts(own, length, gram, unit) for unit, length, gram in kinds if len(own := pdf[pdf.f & 1 == (unit == WORD)])]
    give_back()
    return _joined(out)


def _in_parts(pdf: pd.DataFrame, length: int, gram: int, unit: int = 1) -> pd.DataFrame:
    """A shard in runs of whole (gram, sub) groups whose bytes fit one suffix array."""
    pdf = pdf[may_repeat(pdf, length, gram, unit)]
    if not len(pdf):
        return _joined([])
    pdf = pdf.sort_values(["f", "sub", RID, "s0"], kind="stable").reset_index(drop=True)
    size = pdf.ctx.str.len().to_numpy()
    group = ((pdf.f != pdf.f.shift()) | (pdf["sub"] != pdf["sub"].shift())).cumsum().to_numpy()
    whole = np.bincount(group, size)[1:]
    out, a, filled = [], 1, 0
    for g, b in enumerate(whole, 1):
        if filled and filled + b > 1_900_000:
            out.append(shard_repeats(pdf[(group >= a) & (group < g)], length, unit))
            a, filled = g, 0
        filled += b
    out.append(shard_repeats(pdf[group >= a], length, unit))
    return _joined(out)


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs under the spans."""
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def covered(ranges: list, size: int, length: int) -> list[tuple[int, int]]:
    """The maximal runs of units under the strings that start in the ranges."""
    return united([(r["a"], min(size, r["b"] + length)) for r in ranges])


def word_spans(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The bytes from the first to the last of each run of words, the white space around it left."""
    at = [m.span() for m in re.finditer(rb"\S+", data)] if runs else []
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside of the spans."""
    at = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(at[::2], at[1::2], strict=True))


def _listed(docs: DataFrame, length: int, gram: int, words: int, word_gram: int) -> DataFrame:
    """(RID, spans): a text's ranges of starts of repeated strings of so many bytes (unit 1) and of so many words (unit WORD)."""
    found = repeats(docs, Workspace(docs.sparkSession), ((1, length, gram), (WORD, words, word_gram)))
    return found.groupBy(RID).agg(F.collect_list(F.struct("unit", "a", "b")).alias("spans"))


def _runs(data: bytes, spans: list | None, length: int, words: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The maximal runs of bytes under repeated strings of bytes, and those of words under repeated strings of words."""
    starts = [r for r in spans or () if r["unit"] == WORD]
    return covered([r for r in spans or () if r["unit"] == 1], len(data), length), covered(starts, len(data.split()), words) if starts else []


def query(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int = WORDS, word_gram: int = WORD_GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text, n_repeated_words, n_passages), a row for each row of documents.

    n_removed, n_spans, kept_sha256 and text are of repeated strings of so many bytes alone; text
    is what is left, without bytes of characters that are cut through. Null and empty texts have
    nothing to remove; an exact copy of a long enough text is removed whole, and so is the first
    of them. n_repeated_words counts the words under repeated strings of so many words, whatever
    their bytes, n_passages their maximal runs; without_repeats takes both kinds out.
    """
    docs = settled(docs)
    kinds = {"doc_id": "long", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "text": "string", "n_repeated_words": "long", "n_passages": "long"}

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                data = row["text"].encode("utf-8", "surrogatepass")
                spans, runs = _runs(data, row["spans"], length, words)
                kept = without(data, spans)
                out.append((row["doc_id"], len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"), sum(b - a for a, b in runs), len(runs)))
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if t == "long" else pa.string()) for x, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    rows = text_rows(docs).join(_listed(docs, length, gram, words, word_gram), RID, "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(lean(run), ", ".join(f"{c} {t}" for c, t in kinds.items()))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int = WORDS, word_gram: int = WORD_GRAM) -> DataFrame:
    """The documents with their own columns, each text without its repeated strings of so many bytes or so many words, and n_chars to match. Both are judged on the input. Bytes of a character that a span cuts through go too."""
    docs = settled(docs)

    def run(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                gone, runs = _runs(data, spans.as_py(), length, words)
                gone += word_spans(data, runs)
                texts.append(without(data, united(gone)).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(texts, pa.string())], ["own", "text"])

    wide = whole_rows(docs).join(_listed(docs, length, gram, words, word_gram), RID, "left").select("own", "text", "spans")
    return retexted(docs, wide.mapInArrow(lean(run), wide.select("own", "text").schema))
