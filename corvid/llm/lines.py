"""Near-duplicate lines: a segment-partition join under edit distance over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import RID, Workspace, lean, retexted, settled, text_rows, whole_rows
from corvid.llm.components import classes, forest, group_heads, in_blocks, once, sharing, whole_groups
from corvid.llm.words import Chunk, Runs, chunks, mix

#: Most word edits between two lines, and the words that each edit takes: the shorter line of a pair has PER_EDIT for each edit, so one edit needs 5 words and two need 10. Lines of fewer words match when their words are equal.
EDITS, PER_EDIT = 2, 5
#: Lines of a block, where a key's lines are compared pair by pair, and pairs that one numpy pass compares.
BLOCK, LANES = 512, 1 << 15


def allowed(n, edits: int = EDITS):
    """Edits that a pair may have whose shorter line has n words."""
    return np.minimum(n // PER_EDIT, edits)


def segments(n: int, edits: int) -> list[tuple[int, int]]:
    """First word and number of words of edits + 1 segments of nearly one length."""
    parts = edits + 1
    short, longer = n // parts, n % parts
    out, at = [], 0
    for k in range(parts):
        size = short + (k >= parts - longer)
        out.append((at, size))
        at += size
    return out


def probes(n: int, edits: int = EDITS) -> list[tuple[int, int, int, int]]:
    """(length, segment, first word, words): the stretches of a line of n words that can equal a segment of a line of that length, n words or less.

    Two lines within the edits agree on a segment that at most k edits precede and the rest
    follow, so it lies at most that far from its own place, seen from the left as from the
    right; places that break either bound can't be needed. The line's own segments, those of
    length n, are among them.
    """
    out = []
    for length in range(max(PER_EDIT, n - edits), n + 1):
        most, shift = int(allowed(length, edits)), n - length
        if shift > most:
            continue
        for k, (at, size) in enumerate(segments(length, most)):
            low = max(0, at - k, at + shift - (most - k))
            high = min(n - size, at + k, at + shift + (most - k))
            out += [(length, k, p, size) for p in range(low, high + 1)]
    return out


_PROBES: dict[tuple[int, int], np.ndarray] = {}
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def line_keys(run: Runs, first: np.ndarray, n: np.ndarray, edits: int = EDITS) -> np.ndarray:
    """A row of 64-bit keys for each line, of all stretches that it is found by, filled up with _NONE; each key once."""
    tables = {}
    for m in np.unique(n).tolist():
        if (m, edits) not in _PROBES:
            _PROBES[m, edits] = np.array(probes(m, edits), np.int64).reshape(-1, 4).T
        tables[m] = _PROBES[m, edits]
    out = np.full((len(n), max((t.shape[1] for t in tables.values()), default=0)), _NONE)
    for m, (length, k, at, size) in tables.items():
        own = np.flatnonzero(n == m)
        h = run(first[own][:, None] + at, size[None, :])
        out[own, : len(at)] = np.minimum(mix(h ^ mix((length << 8 | k).astype(np.uint64))), _NONE - np.uint64(1))
    out.sort(axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = _NONE
    return out


def within(h: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, edits: int) -> np.ndarray:
    """For each pair of stretches of h, n words from a on and m words from b on: the edit distance, edits + 1 if it is more than edits.

    By bit vectors along a band, all pairs side by side. Of each column of a pair's table two
    bit vectors are kept, of rises and falls from one row to the next; the window of rows
    moves down with the column, so only rows within the edits of the diagonal are looked at.
    The score follows the window's lowest row, then the last row. A pair leaves as soon as
    its score can't come back.
    """
    out = np.full(len(a), edits + 1)
    swap = n > m
    a, n, b, m = np.where(swap, b, a), np.where(swap, m, n), np.where(swap, a, b), np.where(swap, n, m)
    # Equal ends are cut off, as far as they reach word by word.
    lane = np.flatnonzero(m - n <= edits)
    a, n, b, m = a[lane].copy(), n[lane].copy(), b[lane].copy(), m[lane].copy()
    for back in (False, True):
        going = np.flatnonzero(n > 0)
        while len(going):
            x = h[a[going] + (n[going] - 1 if back else 0)]
            y = h[b[going] + (m[going] - 1 if back else 0)]
            going = going[x == y]
            n[going] -= 1
            m[going] -= 1
            if not back:
                a[going] += 1
                b[going] += 1
            going = going[n[going] > 0]
    short = n == 0
    out[lane[short]] = m[short]
    lane, a, n, b, m = (x[~short] for x in (lane, a, n, b, m))
    # Bit k of a vector stands for row j - edits - 1 + k of column j; rows above the first equal nothing.
    width = 2 * edits + 2
    full, top = np.int64((1 << width) - 1), np.int64(1 << (width - 1))
    rise, fall = np.full(len(lane), full & ~((1 << (edits + 1)) - 1), np.int64), np.zeros(len(lane), np.int64)
    score, j = np.full(len(lane), edits), 0
    # The lowest row of the window is the last one from the start where a has no more than edits words.
    score[n < edits] = n[n < edits]
    rows = np.arange(width)
    while len(lane):
        at = j - edits - 1
        place = at + rows
        inside = (place >= 0) & (place < n[:, None])
        same = inside & (h[np.where(inside, a[:, None] + place, 0)] == h[b + j][:, None])
        eq = same @ (np.int64(1) << rows)
        d0 = ((((eq & rise) + rise) ^ rise) | eq | fall) & full
        hp, hn = (fall | ~(d0 | rise)) & full, d0 & rise
        inner = j < n - edits
        bit = np.int64(1) << np.where(inner, 0, n - 1 - at)
        score += np.where(inner, (d0 & top) == 0, ((hp & bit) != 0).astype(np.int64) - ((hn & bit) != 0))
        rise, fall = (hn | ~((d0 >> 1) | hp)) & full, (d0 >> 1) & hp
        j += 1
        # From here on the score falls by one a step at most, and only along the last row.
        done = j == m
        out[lane[done]] = np.minimum(score[done], edits + 1)
        going = ~done & (score <= edits + np.minimum(m - j, m - n + edits))
        if not going.all():
            lane, a, n, b, m, rise, fall, score = (x[going] for x in (lane, a, n, b, m, rise, fall, score))
    return out


def _spans(chunk: Chunk, a: np.ndarray, b: np.ndarray) -> list:
    """The bytes of each line of a chunk, words a to b, with one space between two words."""
    odd, data = chunk.odd_gaps(), memoryview(chunk.data)
    plain = odd[b] == odd[np.minimum(a + 1, b)]
    return [data[s:e] if p else b" ".join(bytes(data[s:e]).split()) for s, e, p in zip(chunk.starts[a].tolist(), chunk.ends[b - 1].tolist(), plain.tolist(), strict=True)]


def occurrences(docs: DataFrame) -> DataFrame:
    """(RID, doc_id, line_no, id): a row for each line with a word in it; id is a 128-bit digest of its words."""

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column("text")):
                text, number, a, b = c.lines()
                own = np.flatnonzero(b > a)
                ids = [xxhash.xxh3_128_digest(x) for x in _spans(c, a[own], b[own])]
                at = pa.array(text[own] + c.first)
                yield pa.RecordBatch.from_arrays([batch.column(RID).take(at), batch.column("doc_id").take(at), pa.array(number[own]), pa.array(ids, pa.binary())], [RID, "doc_id", "line_no", "id"])

    return text_rows(docs).mapInArrow(lean(run), f"{RID} long, doc_id long, line_no long, id binary")


def _distinct(chunk: Chunk) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's runs, and first word, one past the last and 64-bit hash of each different line that may have an edit."""
    _, _, a, b = chunk.lines()
    own = b - a >= PER_EDIT
    run, a, b = Runs(chunk.hashes), a[own], b[own]
    ids, first = np.unique(run(a, b - a), return_index=True)
    return run, a[first], b[first], ids


def keys(docs: DataFrame, edits: int) -> DataFrame:
    """(key, id): all keys of each line that may have an edit; a line once in some 2 MB of text."""

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column("text")):
                runs, a, b, ids = _distinct(c)
                found = line_keys(runs, a, b - a, edits)
                ids = np.repeat(ids, found.shape[1])[found.ravel() != _NONE]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (found[found != _NONE], ids)], ["key", "id"])

    return text_rows(docs).select("text").mapInArrow(lean(run), "key long, id long")


def bodies(docs: DataFrame) -> DataFrame:
    """(id, digest, body) of the lines that keys() has; a line once in some 2 MB of text."""

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column("text")):
                _, a, b, ids = _distinct(c)
                own = [bytes(x) for x in _spans(c, a, b)]
                yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array([xxhash.xxh3_128_digest(x) for x in own], pa.binary()), pa.array(own, pa.binary())], ["id", "digest", "body"])

    return text_rows(docs).select("text").mapInArrow(lean(run), "id long, digest binary, body binary")


def _pairs(heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes i < j of all pairs of rows of one group, by the groups' first rows and the number of rows."""
    size = np.diff(heads)
    ahead = np.repeat(heads[1:], size) - np.arange(heads[-1]) - 1
    i = np.repeat(np.arange(heads[-1]), ahead)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(ahead) - ahead, ahead) + i + 1


def _linked(batch: pa.RecordBatch, edits: int) -> pa.RecordBatch:
    """Of whole groups (key, p, q), sorted: the number of links of each line, and links enough to connect what they connect.

    A pair is counted under the smallest key that both lines have, so once.
    """
    column = batch.column("body")
    parts, first, at = [], [], 0
    for c in chunks(column):
        parts.append(c.hashes)
        first.append(c.bounds + at)
        at += len(c.hashes)
    h = np.concatenate([*parts, np.zeros(1, np.uint64)])
    start = np.concatenate([f[:-1] for f in first])
    n = np.diff(np.append(start, at))
    own_keys = line_keys(Runs(h), start, n, edits)
    key, p, q, own = (batch.column(x).to_numpy() for x in ("key", "p", "q", "own"))
    i, j = _pairs(group_heads(batch))
    most = allowed(np.minimum(n[i], n[j]), edits)
    fit = (np.abs(n[i] - n[j]) <= most) & ((p[i] == q[i]) | (own[i] != own[j]))
    i, j, most = i[fit], j[fit], most[fit]
    held = []
    for k in range(0, len(i), LANES):
        x, y = i[k : k + LANES], j[k : k + LANES]
        own_pair = once(own_keys, x, y, key[x].view(np.uint64), _NONE)
        x, y, limit = x[own_pair], y[own_pair], most[k : k + LANES][own_pair]
        hit = within(h, start[x], n[x], start[y], n[y], edits) <= limit
        held.append((x[hit], y[hit]))
    i, j = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in held)]) for k in (0, 1))
    # A line may stand in several groups: its places are one node here.
    ids = batch.column("digest").dictionary_encode()
    node = ids.indices.to_numpy()
    a, b = node[i], node[j]
    count = np.bincount(np.concatenate([a, b]), minlength=len(ids.dictionary))
    linked = np.flatnonzero(count)
    a, b = forest(a, b, len(count))
    none = pa.nulls(len(linked), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([ids.dictionary.take(pa.array(x)) for x in (linked, a)]), pa.concat_arrays([none, ids.dictionary.take(pa.array(b))]), pa.array(np.concatenate([count[linked], np.zeros(len(a), np.int64)]))],
        ["a", "b", "links"],
    )


def line_links(docs: DataFrame, work: Workspace, edits: int = EDITS) -> tuple[DataFrame, DataFrame]:
    """(id, links), how many different lines lie within the edits of each line that has any, and the classes (id, root) that these links make.

    Keys alone are shuffled first: only those that two lines share go on, and only the lines
    that have such a key are fetched. A key's lines are compared pair by pair, in blocks of
    BLOCK lines and each pair of blocks by itself. Pairs are never written: a task emits
    counts, and a forest of its links.
    """
    shared = work.put(sharing(keys(docs, edits), F.lit(1), BLOCK), "shared")
    wanted = shared.select("id").distinct()
    texts = work.put(bodies(docs).join(wanted, "id", "left_semi").dropDuplicates(["id", "digest"]), "texts")

    def run(batches):
        for part in whole_groups(batches):
            yield _linked(part, edits)

    found = work.put(in_blocks(shared.join(texts, "id"), "digest", "digest", "body").mapInArrow(lean(run), "a binary, b binary, links long"), "links")
    work.drop(shared, texts)
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    return counts, classes(found.where("b is not null").select("a", "b"), work)


def line_classes(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(RID, doc_id, line_no, class_id, first_doc_id, first_line, links, keep): a row for each line that has a word.

    Lines are of one class when their words are equal or links connect them; class_id is the
    smallest digest in it, in hexadecimal. keep holds for the first line of a class, by
    doc_id (null first), row and line. links counts all other texts within the edits of a
    line's text. Blank lines are no part of any class; null and empty texts have no line.
    """
    docs = settled(docs)
    work = Workspace(docs.sparkSession)
    counts, root = line_links(docs, work, edits)
    at = work.put(occurrences(docs), "lines")
    own = at.groupBy("id").agg(F.min(F.struct("doc_id", RID, "line_no")).alias("own"), F.count("*").alias("n")).join(root, "id", "left").join(counts, "id", "left")
    own = work.put(own.select("id", "own", "n", F.coalesce("root", "id").alias("root"), F.col("root").isNotNull().alias("near"), F.coalesce("links", F.lit(0)).alias("links")).where("n > 1 or near"), "repeated")
    first = own.where("near").groupBy("root").agg(F.min("own").alias("first"))
    known = own.join(first, "root", "left").select("id", "root", F.coalesce("first", "own").alias("first"), "links")
    # Lines that stand alone are their own class.
    all_ = at.join(known, "id", "left").withColumn("first", F.coalesce("first", F.struct("doc_id", RID, "line_no")))
    keep = (F.col(RID) == F.col(f"first.{RID}")) & (F.col("line_no") == F.col("first.line_no"))
    return all_.select(
        RID, "doc_id", "line_no", F.lower(F.hex(F.coalesce("root", "id"))).alias("class_id"), F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.line_no").alias("first_line"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), keep.alias("keep"),
    )


def query(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, class_id, first_doc_id, first_line, links, keep) of every line."""
    return line_classes(docs).drop(RID)


def without_repeats(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """The documents with their own columns; each text keeps its blank lines and the first line of each class, and n_chars follows. No document goes; a text may become empty."""
    docs = settled(docs)
    dropped = line_classes(docs, edits).where("not keep").groupBy(RID).agg(F.collect_list("line_no").alias("drop"))

    def run(batches):
        for batch in batches:
            texts = []
            for text, drop in zip(batch.column("text"), batch.column("drop"), strict=True):
                gone = set(drop.as_py() or ())
                texts.append("\n".join(x for k, x in enumerate(text.as_py().split("\n")) if k not in gone) if gone else text.as_py())
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(texts, pa.string())], ["own", "text"])

    wide = whole_rows(docs).join(dropped, RID, "left").select("own", "text", "drop")
    return retexted(docs, wide.mapInArrow(lean(run), wide.select("own", "text").schema))
