"""Near-duplicate documents by order MinHash over five-word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import RID, Workspace, lean, settled, text_rows
from corvid.llm.components import classes, find, group_heads, in_blocks, once, sharing, whole_groups
from corvid.llm.words import Chunk, Runs, chunks, mix, powers

#: Words in a shingle, least similarity, samples, and minimum shingles in a sample. Two texts of similarity 0.8 agree in a sample with a chance of about 0.8 ** 3, so none of 16 samples shows them with a chance of 1e-5.
SHINGLE, SIMILAR, SAMPLES, MINIMA = 5, 0.8, 16, 3
#: Texts of a block, where a key's texts are compared pair by pair, and the most bytes of it where texts are long.
BLOCK, BLOCK_BYTES = 1024, 1 << 24
#: Pairs whose keys are compared at once.
LANES = 1 << 14
#: Shingles that one matrix product counts.
COLUMNS = 2048
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Key of no sample; a text of no words has no other.
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts of a chunk, in text order: hashes of the shingles, these labelled with the number of equals before them in the text, and each text's first shingle (one past the last at the end).

    A text of fewer words than a shingle is one shingle, one without words none.
    """
    bounds = chunk.bounds
    words = np.diff(bounds)
    size = np.where(words > 0, np.maximum(1, words - SHINGLE + 1), 0)
    first = np.concatenate([[0], np.cumsum(size)])
    text = np.repeat(np.arange(len(size)), size)
    h = Runs(chunk.hashes)(np.arange(first[-1]) - first[text] + bounds[text], np.minimum(SHINGLE, words)[text])
    own = mix(h + text.astype(np.uint64) * _A)
    order = np.argsort(own, kind="stable")
    s, here = own[order], np.arange(len(h))
    head = np.concatenate([[True], s[1:] != s[:-1]])[: len(h)]
    before = np.empty(len(h), np.uint64)
    before[order] = here - np.maximum.accumulate(np.where(head, here, 0))
    return h, mix(h + before * _B), first


def sketches(chunk: Chunk, samples: int = SAMPLES, minima: int = MINIMA) -> np.ndarray:
    """A 64-bit key for each text and sample: its smallest labelled shingles, in the order in which they stand in the text."""
    h, marks, first = shingles(chunk)
    seeds = mix(np.arange(1, samples + 1, dtype=np.uint64) * _A)
    out = np.full((len(first) - 1, samples), _NONE)
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a > minima:
            v = marks[a:b] ^ seeds[:, None]
            v *= _B
            v ^= v >> np.uint64(32)
            at = np.sort(np.argpartition(v, minima - 1, axis=1)[:, :minima], axis=1) + a
        else:
            at = np.broadcast_to(np.arange(a, b), (samples, b - a))
        z = seeds
        for column in at.T:
            z = mix(z) + h[column]
        if b > a:
            out[k] = np.minimum(mix(z), _NONE - np.uint64(1))
    return out


class Prefix:
    """Equal stretches of two sequences of hashes, by prefix sums."""

    _BASE = 0xE7037ED1A0B428DB
    _up = np.ones(1, np.uint64)

    def __init__(self, a: np.ndarray, b: np.ndarray):
        n = max(len(a), len(b)) + 1
        if len(Prefix._up) < n:
            Prefix._up = powers(self._BASE, 2 * n)
        self.n, self.m = len(a), len(b)
        self.a, self.b = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * Prefix._up[: len(x)])]) for x in (a, b))

    def reach(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words equal from i in one and j in the other on, for each pair of places, found by halving."""
        most = np.minimum(self.n - i, self.m - j)
        out, step = np.zeros(len(i), np.int64), 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
        i_up, j_up = Prefix._up[j], Prefix._up[i]
        while step:
            end = out + step
            fit = np.flatnonzero(end <= most)
            x, y, e = i[fit], j[fit], end[fit]
            alike = (self.a[x + e] - self.a[x]) * i_up[fit] == (self.b[y + e] - self.b[y]) * j_up[fit]
            out[fit[alike]] = e[alike]
            step >>= 1
        return out


def aligned_runs(a: np.ndarray, b: np.ndarray, band: int) -> list[int] | None:
    """Lengths of the runs of equal words in an alignment with the fewest insertions and deletions, None if they are more than band.

    All diagonals that a number of edits can reach advance side by side, each as far as its
    words are equal. 32 bits are kept for each edit and diagonal.
    """
    n, m = len(a), len(b)
    near, nothing = Prefix(a, b), -(1 << 30)
    at = np.full(2 * band + 5, nothing, np.int64)
    zero = band + 2
    at[zero] = near.reach(np.zeros(1, np.int64), np.zeros(1, np.int64))[0]
    steps = [at[zero : zero + 1].astype(np.int32)]
    if at[zero] >= n and at[zero] >= m:
        return _traced(steps, n, m)
    for d in range(1, band + 1):
        k = np.arange(-d, d + 1, 2)
        left, right = at[zero + k - 1], at[zero + k + 1]
        x = np.maximum(left + 1, right)
        y = x - k
        ok = (x >= 0) & (x <= n) & (y >= 0) & (y <= m)
        x = np.where(ok, x, nothing)
        own = np.flatnonzero(ok)
        x[own] += near.reach(x[own], y[own])
        at[zero + k] = x
        steps.append(x.astype(np.int32))
        if abs(n - m) <= d and (d - n + m) % 2 == 0 and at[zero + n - m] >= n:
            return _traced(steps, n, m)
    return None


def _traced(steps: list[np.ndarray], n: int, m: int) -> list[int]:
    """The runs of the path that ends at the last step, from its end on. steps[d] has diagonals -d, -d + 2, ... d."""
    runs, x, k = [], n, n - m
    for d in range(len(steps) - 1, 0, -1):
        before, own = steps[d - 1], (k + d) // 2
        left = int(before[own - 1]) + 1 if own > 0 else -1
        right = int(before[own]) if own < d else -1
        start, k = (left, k - 1) if left >= right else (right, k + 1)
        runs.append(x - start)
        x = start if left < right else start - 1
    return [*runs, x]


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """Shingles of two word sequences that an alignment keeps, over all of both; 0 as soon as it must be under least.

    A shingle is kept when all of its words are aligned in a row. The alignment has the fewest
    insertions and deletions; it is found along diagonals, each as far as it gets with so many
    edits, and only within the band that the similarity allows.
    """
    if len(a) < SHINGLE or len(b) < SHINGLE:
        return float(len(a) == len(b) and bool((a == b).all()))
    na, nb = len(a) - SHINGLE + 1, len(b) - SHINGLE + 1
    # kept / (na + nb - kept) >= least needs as many kept, and each edit loses a shingle at least.
    need = least * (na + nb) / (1 + least)
    if min(na, nb) < need - 1e-9:
        return 0.0
    runs = aligned_runs(a, b, int(na + nb - 2 * need) + 1)
    kept = sum(max(0, n - SHINGLE + 1) for n in runs or ())
    return kept / (na + nb - kept) if kept >= need - 1e-9 else 0.0


def common(marks: np.ndarray, heads: np.ndarray, columns: int = COLUMNS) -> np.ndarray:
    """Labelled shingles that each two of some texts have in common: text k has those from heads[k] on. Matrix products over those that two texts have at least."""
    n = len(heads) - 1
    _, kind, times = np.unique(marks, return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.where(shared, np.cumsum(shared) - 1, -1)[kind]
    text = np.repeat(np.arange(n), np.diff(heads))
    own = column >= 0
    column, text = column[own], text[own]
    order = np.argsort(column, kind="stable")
    column, text = column[order], text[order]
    out = np.zeros((n, n), np.float32)
    for a in range(0, int(shared.sum()), columns):
        lo, hi = np.searchsorted(column, [a, a + columns])
        x = np.zeros((n, min(columns, int(shared.sum()) - a)), np.float32)
        x[text[lo:hi], column[lo:hi] - a] = 1
        out += x @ x.T
    return out


def _linked(batch: pa.RecordBatch, least: float) -> pa.RecordBatch:
    """Links (a, b), enough to connect what the verified pairs of whole groups (key, p, q) connect.

    A pair is looked at under the smallest key that both texts have. It is aligned if the two
    have shingles enough in common for the similarity, and links aligned before don't connect
    them.
    """
    words, marks, word_at, mark_at = [], [], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for c in chunks(batch.column("body")):
        _, m, first = shingles(c)
        words.append(c.hashes), marks.append(m)
        word_at.append(c.bounds[1:] + word_at[-1][-1]), mark_at.append(first[1:] + mark_at[-1][-1])
    words, marks, word_at, mark_at = (np.concatenate(x) for x in (words, marks, word_at, mark_at))
    size = np.diff(mark_at)
    own_keys = batch.column("keys").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
    key, p, q, own = (batch.column(x).to_numpy() for x in ("key", "p", "q", "own"))
    i, j, share = [], [], []
    heads = group_heads(batch)
    for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
        both = common(marks[mark_at[a] : mark_at[b]], mark_at[a : b + 1] - mark_at[a])
        total = (size[a:b][:, None] + size[a:b]).astype(np.float32)
        hit = np.triu(both >= least * total / (1 + least) - 1e-3, 1)
        if p[a] != q[a]:
            hit &= own[a:b][:, None] != own[a:b]
        x, y = np.nonzero(hit)
        # Near copies share most keys: a pair is let go at once but under one of them, so that few are held.
        mine = [once(own_keys, x[s : s + LANES] + a, y[s : s + LANES] + a, key[a : a + 1].view(np.uint64), _NONE) for s in range(0, len(x), LANES)]
        mine = np.concatenate([np.zeros(0, bool), *mine])
        x, y = x[mine], y[mine]
        i.append((x + a).astype(np.int32)), j.append((y + a).astype(np.int32)), share.append(both[x, y] / total[x, y])
    i, j, share = np.concatenate(i), np.concatenate(j), np.concatenate(share)
    order = np.argsort(-share, kind="stable")
    i, j = i[order], j[order]
    ids, node = np.unique(batch.column("id").to_numpy(), return_inverse=True)
    root, one, other = list(range(len(ids))), [], []
    for s in range(0, len(i), LANES):
        for r, t in zip(i[s : s + LANES].tolist(), j[s : s + LANES].tolist(), strict=True):
            u, v = find(root, int(node[r])), find(root, int(node[t]))
            if u != v and similarity(words[word_at[r] : word_at[r + 1]], words[word_at[t] : word_at[t + 1]], least) >= least:
                root[max(u, v)] = min(u, v)
                one.append(node[r]), other.append(node[t])
    return pa.RecordBatch.from_arrays([pa.array(ids[np.array(x, np.int64)]) for x in (one, other)], ["a", "b"])


def near_classes(docs: DataFrame, least: float = SIMILAR, samples: int = SAMPLES, minima: int = MINIMA) -> DataFrame:
    """(RID, doc_id, root): a row for each document with the RID of the first of its class, by RID.

    Equal texts are one class, and so are texts that verified links connect; case and white
    space don't count. A text of fewer words than a shingle matches texts of the same words
    only; texts without words, empty and null ones among them, match equal ones. All pairs of
    different texts that agree in a sample are compared, but for those that other links
    connect: keys alone are shuffled first, then the texts whose key another has.
    """
    docs = settled(docs)
    work = Workspace(docs.sparkSession)
    rows = text_rows(docs).withColumn("lower", F.lower("text"))
    out = f"{RID} long, doc_id long, digest binary, size long, keys array<long>"

    def run(batches):
        for batch in batches:
            keys = np.concatenate([np.zeros((0, samples), np.uint64), *(sketches(c, samples, minima) for c in chunks(batch.column("lower")))])
            texts = [t.as_py().encode("utf-8", "surrogatepass") for t in batch.column("text")]
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * samples, pa.int32()), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(RID), batch.column("doc_id"), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), listed],
                [RID, "doc_id", "digest", "size", "keys"],
            )

    sketched = work.put(rows.mapInArrow(lean(run), out), "sketches")
    lead = sketched.groupBy("digest").agg(F.min(F.struct(RID, "size", "keys")).alias("s")).select("digest", F.col(f"s.{RID}").alias("id"), "s.size", "s.keys")
    lead = work.put(lead, "distinct")
    keyed = lead.select("id", "size", F.explode(F.array_distinct("keys")).alias("key")).where(F.col("key") != -1)
    shared = work.put(sharing(keyed, F.greatest(F.col("size").cast("double") / BLOCK_BYTES, F.lit(1.0 / BLOCK)), 1), "shared")
    wanted = shared.select(F.col("id").alias(RID)).distinct().join(lead.select(F.col("id").alias(RID), "keys"), RID)
    texts = work.put(rows.join(wanted, RID).select(F.col(RID).alias("id"), F.col("lower").alias("body"), "keys"), "texts")

    def link(batches):
        for part in whole_groups(batches):
            yield _linked(part, least)

    links = work.put(in_blocks(shared.join(texts, "id"), "id", "id", "keys", "body").mapInArrow(lean(link), "a long, b long"), "links")
    work.drop(shared, texts)
    root = classes(links, work)
    known = lead.select("digest", "id").join(root, "id", "left").select("digest", F.coalesce("root", "id").alias("root"))
    return sketched.select(RID, "doc_id", "digest").join(known, "digest").select(RID, "doc_id", "root")


def query(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size): class_id is the smallest doc_id of the class; null ids count in it only if there is no other."""
    rows = near_classes(docs)
    size = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(size, "root").select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The documents with their own columns, one of each class: that of the smallest doc_id (null first), then of the first row."""
    docs = settled(docs)
    first = near_classes(docs, least).groupBy("root").agg(F.min(F.struct("doc_id", RID)).alias("f")).select(f"f.{RID}")
    wide = docs.select(F.monotonically_increasing_id().alias(RID), F.struct(*docs.columns).alias("own"))
    return wide.join(first, RID, "left_semi").select("own.*")
