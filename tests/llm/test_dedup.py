import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from corvid.llm import lines, ordermin, suffix, words
from corvid.llm.common import Workspace
from hypothesis import given, settings
from hypothesis import strategies as st


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14)), max_size=12), st.integers(0, 4))
def test_within(pairs, edits):
    """All pairs side by side, against a whole table of distances for each."""
    flat, at = [], []
    for a, b in pairs:
        at.append((len(flat), len(a), len(flat) + len(a), len(b)))
        flat += a + b
    at = np.array(at, np.int64).reshape(-1, 4).T
    assert lines.within(np.array([*flat, 9], np.uint64), *at, edits).tolist() == [min(edits + 1, edit_distance(a, b)) for a, b in pairs]


def test_within_edited():
    rng, flat, at, want = random.Random(1), [], [], []
    for _ in range(2000):
        a = [rng.randrange(6) for _ in range(rng.randrange(8, 40))]
        b = list(a)
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(b))
            b[k : k + rng.randrange(2)] = [rng.randrange(6)] * rng.randrange(2)
        at.append((len(flat), len(a), len(flat) + len(a), len(b)))
        flat += a + b
        want.append(min(3, edit_distance(a, b)))
    assert lines.within(np.array(flat, np.uint64), *np.array(at).T, 2).tolist() == want


def within_reach(a, b):
    return edit_distance(a, b) <= min(2, min(len(a), len(b)) // 5)


def test_close_lines_share_a_key():
    rng = random.Random(2)
    for _ in range(3000):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(5, 30))]
        b = list(a)
        for _ in range(rng.randrange(1, 3)):
            k = rng.randrange(len(b))
            b[k : k + rng.randrange(2)] = [rng.choice("abcdefgh")] * rng.randrange(2)
        if min(len(a), len(b)) >= 5 and within_reach(a, b):
            h = np.array([ord(x) for x in a + b], np.uint64)
            keys = lines.line_keys(words.Runs(h), np.array([0, len(a)]), np.array([len(a), len(b)]))
            assert set(keys[0].tolist()) & set(keys[1].tolist()) - {int(lines._NONE)}


def test_words_are_those_of_the_bytes():
    """Words, lines and equal hashes of a column in several chunks, of long words and odd white space."""
    texts = ["", "a", " a  b\tb\n\nb a \n", "\n", "x" * 70_000 + " y", "é é\u00a0é", "c\r\nd", "", "x" * 70_000 + " z", "a\n"] * 3
    held, k = {}, 0
    for c in words.chunks(pa.array(["first", *texts]).slice(1)):
        text, number, a, b = c.lines()
        for t, no, x, y in zip(text.tolist(), number.tolist(), a.tolist(), b.tolist()):
            line = texts[c.first + t].encode().split(b"\n")[no].split()
            assert [bytes(c.data[s:e]) for s, e in zip(c.starts[x:y], c.ends[x:y])] == line
            for w, h in zip(line, c.hashes[x:y].tolist()):
                assert held.setdefault(w, h) == h
            k += 1
    assert k == sum(t.count("\n") + 1 for t in texts) and len(set(held.values())) == len(held)


def test_large_keys_are_searched_to_the_end(spark, monkeypatch):
    """Pairs of close lines and texts among many that share a key with all of them and are close to no other, in small blocks."""
    monkeypatch.setattr(lines, "BLOCK", 7), monkeypatch.setattr(ordermin, "BLOCK", 7)
    rng = random.Random(9)
    same, docs, want = [f"w{k}" for k in range(8)], [], set()
    for k in range(20):
        body = [*same, *(str(rng.randrange(10**6)) for _ in range(9))]
        docs += [(2 * k, " ".join(body)), (2 * k + 1, " ".join([*body[:10], "new", *body[10:]]))]
        want.add((2 * k, 2 * k + 1))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = defaultdict(list)
    for r in lines.query(df).collect():
        got[r["class_id"]].append(r["doc_id"])
        assert r["links"] == 1
    assert {tuple(sorted(g)) for g in got.values()} == want
    passage, docs = [f"w{k}" for k in range(40)], []
    for k in range(20):
        body = [*passage, *(str(rng.randrange(10**6)) for _ in range(70))]
        docs += [(2 * k, " ".join(body)), (2 * k + 1, " ".join([*body[:60], "new", *body[60:]]))]
    got = defaultdict(list)
    for r in ordermin.query(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got[r["class_id"]].append(r["doc_id"])
    assert {tuple(sorted(g)) for g in got.values()} == want


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(k) for k in range(n)]


def varied(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice("uvwxyz") * 4
    return w


def test_line_classes(spark, odd, none):
    rng = random.Random(3)
    base = [[rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(30)) for _ in range(rng.randrange(4, 25))] for _ in range(25)]
    docs = []
    for k in range(120):
        docs.append((k, "\n".join("" if rng.random() < 0.1 else ("  " if rng.random() < 0.2 else " ").join(varied(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 4]))) for _ in range(rng.randrange(5)))))
    docs += [(130, None), (131, ""), (132, "\n\n"), (None, " ".join(base[0]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = lines.query(df).collect()
    at = [(d, k, line.split()) for d, t in docs for k, line in enumerate((t or "").split("\n")) if line.split()]
    links = [(i, j) for i in range(len(at)) for j in range(i) if at[i][2] == at[j][2] or within_reach(at[i][2], at[j][2])]
    want = groups(len(at), links)
    own = {(d, k): g for (d, k, _), g in zip(at, want)}
    assert len(rows) == len(at)
    pairs = {(r["class_id"], own[r["doc_id"], r["line_no"]]) for r in rows}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    first = {}
    for (d, k), g in own.items():
        first[g] = min(first.get(g, ((9, 0), 0)), ((0, -1) if d is None else (1, d), k)) if g in first else ((0, -1) if d is None else (1, d), k)
    assert all(r["keep"] == (first[own[r["doc_id"], r["line_no"]]] == ((0, -1) if r["doc_id"] is None else (1, r["doc_id"]), r["line_no"])) for r in rows)
    kept = lines.without_repeats(df)
    assert kept.columns == df.columns and kept.count() == len(docs)
    left = [w for r in kept.collect() for w in (x.split() for x in r["text"].split("\n")) if w]
    assert len(left) == len(set(want))
    assert lines.without_repeats(odd).columns == odd.columns
    assert lines.query(none).count() == 0 and lines.without_repeats(none).count() == 0


def test_line_links_are_all_counted(spark, monkeypatch):
    """Mutually close lines, and chains whose ends are not close: links of each line by brute force."""
    rng = random.Random(10)
    base = [[f"{k}w{j}" for j in range(14)] for k in range(4)]
    texts = {" ".join(base[0][:5] + [x] + base[0][5:]) for x in "abc"}
    texts |= {" ".join(varied(rng, base[k], n)) for k in range(1, 4) for n in (1, 2, 3) for _ in range(12)}
    texts = sorted(texts)
    split = [t.split() for t in texts]
    want = {t: sum(i != j and within_reach(split[i], w) for j, w in enumerate(split)) for i, t in enumerate(texts)}
    assert max(want.values()) > 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (512, 5):
        monkeypatch.setattr(lines, "BLOCK", block)
        assert {texts[r["doc_id"]]: r["links"] for r in lines.query(df).collect()} == want


def jaccard(a, b):
    def marks(t):
        w, seen, out = t.lower().split(), Counter(), set()
        if len(w) < 5:
            return {tuple(w)}
        for k in range(len(w) - 4):
            s = tuple(w[k : k + 5])
            out.add((s, seen[s]))
            seen[s] += 1
        return out

    x, y = marks(a), marks(b)
    return len(x & y) / len(x | y)


def hashes(text):
    return np.concatenate([c.hashes for c in words.chunks(pa.array([text.lower()]))])


def test_similarity_is_near_shared_shingles():
    rng = random.Random(4)
    for _ in range(200):
        a = [str(rng.randrange(500)) for _ in range(rng.randrange(20, 300))]
        b = varied(rng, a, rng.randrange(6))
        want = jaccard(" ".join(a), " ".join(b))
        got = ordermin.similarity(hashes(" ".join(a)), hashes(" ".join(b)))
        assert got <= want + 1e-9
        assert got >= 0.8 or want < 0.83
    assert ordermin.similarity(hashes("a b"), hashes("a  b")) == 1.0
    assert ordermin.similarity(hashes(""), hashes("a b c d e f")) == 0.0


def test_aligned_runs_are_a_shortest_script():
    rng = random.Random(11)
    for _ in range(600):
        a = [rng.randrange(6) for _ in range(rng.randrange(30))]
        b = varied_numbers(rng, a)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] if x == y else 1 + min(row[j], new[-1]))
            row = new
        x, y = (words.mix(np.array(v, np.uint64)) for v in (a, b))
        runs = ordermin.aligned_runs(x, y, 60)
        assert len(runs) - 1 == row[-1] and 2 * sum(runs) + row[-1] == len(a) + len(b) and min(runs) >= 0
        assert row[-1] == 0 or ordermin.aligned_runs(x, y, row[-1] - 1) is None


def varied_numbers(rng, a):
    b = list(a)
    for _ in range(rng.randrange(6)):
        k = rng.randrange(len(b) + 1)
        b[k : k + rng.randrange(2)] = [rng.randrange(6)] * rng.randrange(2)
    return b


def test_common_shingles_and_long_texts():
    """Counts against sets, in narrow slices; a long text and its edited copy."""
    rng = random.Random(12)
    texts = [" ".join(str(rng.randrange(30)) for _ in range(rng.randrange(5, 40))) for _ in range(30)]
    texts += [t + " end" for t in texts]
    c = next(words.chunks(pa.array(texts)))
    _, marks, first = ordermin.shingles(c)
    both, n = ordermin.common(marks, first, 7), np.diff(first)
    for i in range(len(texts)):
        for j in range(i):
            assert abs(both[i, j] / (n[i] + n[j] - both[i, j]) - jaccard(texts[i], texts[j])) < 1e-6
    long_ = [str(rng.randrange(10**6)) for _ in range(60_000)]
    x, y = hashes(" ".join(long_)), hashes(" ".join(varied(rng, long_, 500)))
    assert 0.9 < ordermin.similarity(x, y) < 1


def test_near_classes(spark, odd, none):
    rng = random.Random(5)
    base = [[str(rng.randrange(1000)) for _ in range(rng.randrange(60, 200))] for _ in range(30)]
    docs = [(k, " ".join(b)) for k, b in enumerate(base)]
    for k in range(100, 200):
        docs.append((k, " ".join(varied(rng, base[rng.randrange(12)], rng.choice([0, 1, 2, 30])))))
    docs += [(300, None), (301, ""), (302, "a b"), (303, "a b"), (304, "a c"), (300, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = ordermin.query(df).collect()
    assert len(rows) == len(docs)
    texts = [t or "" for _, t in docs]
    sure = groups(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if texts[i] == texts[j] or (texts[i].strip() and texts[j].strip() and jaccard(texts[i], texts[j]) >= 0.81)])
    may = groups(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if texts[i] == texts[j] or (texts[i].strip() and texts[j].strip() and jaccard(texts[i], texts[j]) >= 0.79)])
    got = {r["doc_id"]: r["class_id"] for r in rows}
    for g, joined in ((sure, True), (may, False)):
        for i, (d, _) in enumerate(docs):
            for j, (e, _) in enumerate(docs):
                if joined and g[i] == g[j]:
                    assert got[d] == got[e]
                if not joined and g[i] != g[j]:
                    assert got[d] != got[e]
    kept = ordermin.one_of_each(df)
    assert kept.count() == len(set(got.values()))
    assert ordermin.one_of_each(odd).columns == odd.columns
    assert ordermin.query(none).count() == 0


def brute_removed(texts, length):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((gone[1:] < gone[:-1]).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def passages(rng, n=60):
    parts = ["".join(rng.choice("abé ") for _ in range(rng.randrange(20, 200))) for _ in range(12)]
    return ["".join(rng.choice(parts) if rng.random() < 0.6 else "".join(rng.choice("abcd") for _ in range(rng.randrange(80))) for _ in range(rng.randrange(8))) for _ in range(n)] + ["", "é" * 300, "ab" * 200, "x" * 39, parts[0] * 3, parts[0] * 3]


def test_suffix_repeats(spark, odd, none, monkeypatch):
    rng = random.Random(6)
    texts = passages(rng)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None), (0, texts[0])], "doc_id long, text string").repartition(3)
    docs = df.collect()
    want = Counter((d, *x) for (d, _), x in zip(docs, brute_removed([(t or "").encode() for _, t in docs], 40)))
    for per_gram, per_shard in ((2000, 2500), (3, 20)):
        monkeypatch.setattr(suffix, "PER_GRAM", per_gram), monkeypatch.setattr(suffix, "PER_SHARD", per_shard)
        got = suffix.query(df, 40, 10).collect()
        assert Counter(tuple(r)[:5] for r in got) == want
        assert sum(len(r["text"]) for r in got) > 0 and all(r["text"] == "" for r in got if r["n_removed"] == r["n_bytes"])
    monkeypatch.setattr(suffix, "PER_GRAM", 2000)
    assert suffix.query(odd).count() == odd.count()
    assert suffix.without_repeats(odd).columns == odd.columns
    assert suffix.query(none).count() == 0
    assert not suffix.repeats(none, Workspace(spark)).count()


def brute_words(texts, length):
    """The texts without runs of words under strings of so many words that start elsewhere, too; the white space around a run stays."""
    count, out = Counter(), []
    at = [list(re.finditer(r"\S+", t)) for t in texts]
    words = [[m.group() for m in x] for x in at]
    for w in words:
        count.update(tuple(w[k : k + length]) for k in range(len(w) - length + 1))
    for t, x, w in zip(texts, at, words):
        gone = {j for k in range(len(w) - length + 1) if count[tuple(w[k : k + length])] > 1 for j in range(k, k + length)}
        keep, end = [], 0
        for j in sorted(gone):
            a = x[j - 1].end() if j - 1 in gone else x[j].start()
            keep.append(t[end:a])
            end = x[j].end()
        out.append("".join(keep) + t[end:])
    return out


def test_suffix_repeats_of_words(spark, monkeypatch):
    rng = random.Random(9)
    parts = [[rng.choice(["a", "bé", "c,", "dd"]) for _ in range(rng.randrange(3, 14))] for _ in range(14)]
    texts = ["".join(w + rng.choice([" ", "\n", "  "]) for _ in range(rng.randrange(7)) for w in (rng.choice(parts) if rng.random() < 0.5 else [str(rng.randrange(30)) for _ in range(rng.randrange(9))])) for _ in range(70)]
    texts += ["", " ", "a a a a a a a a", "one", "x y z u"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_words(texts, 5)
    assert sum(a != b for a, b in zip(texts, want)) > 20 and sum(a == b for a, b in zip(texts, want)) > 10
    for per_gram, per_shard in ((2000, 2500), (3, 20)):
        monkeypatch.setattr(suffix, "PER_GRAM", per_gram), monkeypatch.setattr(suffix, "PER_SHARD", per_shard)
        got = {r["doc_id"]: r["text"] for r in suffix.without_repeats(df, 5000, 100, 5, 2).collect()}
        assert [got[k] for k in range(len(texts))] == want


def test_passages_of_over_50_words_go_whatever_their_bytes(spark):
    rng = random.Random(10)
    word = lambda n=3: "".join(rng.choice("abcdefghij") for _ in range(n))
    words = lambda k: " ".join(word(rng.randrange(2, 7)) for _ in range(k))
    passage, short, long = words(51), words(49), "".join(word() for _ in range(150))
    assert len(passage) < 400 and len(short) < 400 and len(long) == 450
    texts = [f"{words(30)} {p} {words(30)}" for p in (passage, passage.replace(" ", "\n"), short, short, long, long, words(80))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in suffix.without_repeats(df).collect()}
    assert len(got) == 7 and all(len(got[k].split()) == 60 for k in (0, 1))
    assert all(long not in got[k] for k in (4, 5)) and all(got[k] == texts[k] for k in (2, 3, 6))


def test_query_tells_passages_of_over_50_words(spark):
    rng = random.Random(11)
    words = lambda k: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(k))
    passage, short, long = words(51), words(49), words(150)
    assert len(passage) < 400 < len(long)
    texts = [f"{words(30)} {p} {words(30)}" for p in (passage, passage.replace(" ", "\n"), short, short, long, long, words(80), f"{passage} {words(9)} {passage}")] + ["", passage]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix.query(df).collect()}
    assert [got[k]["n_repeated_words"] for k in (*range(10), 99)] == [51, 51, 0, 0, 150, 150, 0, 102, 0, 51, 0]
    assert [got[k]["n_passages"] for k in (*range(10), 99)] == [1, 1, 0, 0, 1, 1, 0, 2, 0, 1, 0]
    assert [len(t.split()) - len(u.split()) for t, u in zip(texts, brute_words(texts, 50), strict=True)] == [got[k]["n_repeated_words"] for k in range(10)]
    want = brute_removed([t.encode() for t in texts], 400)
    assert [tuple(got[k])[1:5] for k in range(10)] == want and [got[k]["text"] for k in (0, 1, 9)] == [texts[k] for k in (0, 1, 9)]


def test_suffix_order_and_prefixes():
    rng = random.Random(7)
    for _ in range(30):
        ctx = ["".join(rng.choice("ab") for _ in range(rng.randrange(3))).encode() + bytes(rng.choice(b"ab") for _ in range(40)) * 2 for _ in range(5)]
        ctx += [c[1:] for c in ctx[:2]]
        n = np.array([len(c) - 39 for c in ctx])
        base = np.concatenate([[0], np.cumsum([len(c) for c in ctx])[:-1]])
        data = b"".join(ctx)
        starts = np.concatenate([b + np.arange(k) for b, k in zip(base, n)])
        order, same = suffix.suffix_order(data, starts, 40)
        strings = [data[s : s + 40] for s in order]
        assert strings == sorted(strings)
        lcp = suffix.common_prefixes(data, order, same, base, n, 40)
        for k in range(1, len(order)):
            x, y = strings[k - 1], strings[k]
            assert (lcp[k] == 40) == same[k] == (x == y)
            if x != y:
                assert lcp[k] == next(i for i in range(40) if x[i] != y[i])


def test_covered():
    assert suffix.covered([{"a": 0, "b": 0}, {"a": 5, "b": 6}, {"a": 30, "b": 30}], 100, 5) == [(0, 11), (30, 35)]


def test_hot_groups_stay_whole(spark):
    """One text in a third of all rows, with variants: every copy is found."""
    rng = random.Random(8)
    base = [str(rng.randrange(1000)) for _ in range(120)]
    docs = [(k, " ".join(base) if k % 3 == 0 else " ".join(varied(rng, base, 1) if k % 3 == 1 else [str(rng.randrange(1000)) for _ in range(60)])) for k in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = defaultdict(set)
    for r in ordermin.query(df).collect():
        got[r["class_id"]].add(r["doc_id"])
    assert {k for k in range(600) if k % 3 < 2} in got.values()
