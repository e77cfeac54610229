import re
import zlib
from collections import Counter

import numpy as np
from corvid.llm import licenses, topk, toxicity


def test_toxicity_held_out(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    rows = toxicity.query(docs, labels).join(labels, "doc_id").where("held_out").collect()
    pos, neg = ([r["score"] for r in rows if r["toxic"] == k] for k in (1, 0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.8
    assert sum(r["predicted"] for r in rows if not r["toxic"]) <= 0.03 * len(neg) + 1


def test_toxicity_edges(spark, odd, none):
    labels = spark.createDataFrame([(k, None, k % 2) for k in range(12)] + [(1, None, 1), (None, None, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.query(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity.query(none, labels).count() == 0
    assert toxicity.query(odd, labels.limit(0)).count() == odd.count()
    kept = toxicity.keep_clean(odd, labels)
    assert kept.columns == odd.columns


def test_toxicity_keeps_documents_without_both_labels(spark, odd):
    """No labels, none but held-out or null ones, and toxic ones alone."""
    schema = "doc_id long, quality int, toxic int"
    held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 0]
    for rows in ([], [(k, None, k % 2) for k in held], [(k, None, None) for k in range(12)], [(k, None, 1) for k in range(12)]):
        labels = spark.createDataFrame(rows, schema)
        assert toxicity.keep_clean(odd, labels).count() == odd.count()
        assert not any(r["predicted"] for r in toxicity.query(odd, labels).collect())


def test_score_does_not_depend_on_neighbours():
    m = toxicity.Model(toxicity.features("stupid idiot")[::2].astype(np.int64), np.ones(len(toxicity.features("stupid idiot")[::2])), -2.0)
    texts = ["", "idiot", "a" * 50, "stupid idiot", "stup", "id"]
    assert np.allclose(m.scores(texts), [m.scores([t])[0] for t in texts])
    old = toxicity.STRETCH
    try:
        toxicity.STRETCH = 7
        assert np.allclose(m.scores(texts), [1 / (1 + np.exp(2 - np.isin(toxicity.features(t), m.buckets).sum())) for t in texts])
    finally:
        toxicity.STRETCH = old


def brute_phrases(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
    hits = []
    for p, label in licenses.PHRASES.items():
        p = p.split()
        hits += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
    at = [k for k, _ in hits]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_licenses_base(spark, odd, none, sf):
    for df in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = licenses.query(df).collect()
        want = Counter((r["doc_id"], *brute_phrases(r["text"] or "")) for r in df.select("doc_id", "text").collect())
        assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows) == want
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)
    assert licenses.query(none).count() == 0


def test_licenses_notice_with_edits(spark):
    notice = dict(licenses.NOTICES)["bsd"].split()
    edited = notice[:6] + ["very", "new"] + notice[6:20] + notice[21:]
    rows = [(1, "intro " + " ".join(notice)), (2, " ".join(edited)), (3, " ".join(notice[:12])), (4, None)]
    got = {r["doc_id"]: r for r in licenses.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["labels"] for k in (1, 2, 3, 4)] == ["bsd", "bsd", "", ""]
    assert got[1]["score"] == 1.0 and 0.6 < got[2]["score"] < 1 and got[1]["n_base"] == 0


def test_licenses_repeated_piece_is_no_notice(spark):
    """Pieces of a notice that chain by their diagonals alone, and a whole notice among them."""
    piece = "the above copyright notice one two three "
    isc = dict(licenses.NOTICES)["isc"]
    rows = [(1, piece * 30), (2, piece * 30 + isc + " " + piece * 30), (3, isc)]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("", 0.0), 2: ("isc", 1.0), 3: ("isc", 1.0)}


def test_chain():
    assert licenses.chain([(k, 5) for k in range(0, 200, 7)])[0] == 1
    assert licenses.chain([(10 + k, k) for k in range(9)] + [(22 + k, 10 + k) for k in range(9)]) == (18, 10, 30)
    assert licenses.chain([(10 + k, k) for k in range(9)] + [(90 + k, 10 + k) for k in range(7)])[0] == 9


def brute_topk(rows, k, step):
    out = Counter()
    fine = [(n, i, np.floor(64 * np.array(v, float)).astype(int)) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for n, i, v in fine:
        if i % step == 0:
            best = sorted((-int(v @ w), j, m) for m, j, w in fine if m != n and len(w) == len(v))[:k]
            out.update((i, rank + 1, j, -s) for rank, (s, j, _) in enumerate(best))
    return out


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(0, 0.2, 8).round(1).tolist()) for k in range(300)]
    rows += [(20, None), (40, []), (60, [1.0, None] * 4), (80, [float("nan")] * 8), (100, [float("inf")] * 8), (40, rows[40][1]), (120, [0.5] * 3), (121, [0.25] * 3), (None, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    for block, shard, group in ((256, 32, 4096), (16, 4, 3)):
        monkeypatch.setattr(topk, "BLOCK", block), monkeypatch.setattr(topk, "SHARD", shard), monkeypatch.setattr(topk, "GROUP", group)
        assert Counter(map(tuple, topk.query(df).collect())) == brute_topk(rows, 20, 20)
    assert topk.query(df.limit(0)).count() == 0
