import hashlib
import re
from collections import Counter

from corvid.llm import sketch


def parts(text):
    return {p for p in re.split(r"\n|(?<=[.!?])\s+", text) if p.strip(" ")}


def like(a, b):
    x, y = parts(a), parts(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(t, edited), 9), round(like(t, after), 9)))
    return Counter(out)


def test_fingerprints(spark, odd, none, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(10_000 + k, f"One {k % 3}. Two.\nTwo.\nThree {k % 2}!  Four" if k % 4 else None) for k in range(20)] + [(20_000, ". ".join(map(str, range(3000))))]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = sketch.query(df).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows) == brute([(d, t or "") for d, t in df.collect()])
    texts = {d: t or "" for d, t in df.collect()}
    by = {}
    for r in rows:
        assert by.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert ((r["near_edited"] == 1.0) or r["fingerprint"] != r["edited_fingerprint"])
    assert sketch.query(odd).count() == odd.count()
    assert sketch.query(none).count() == 0
    one = sketch.query(df.limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_no_python_in_the_plan(spark, sf):
    plan = sketch.query(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_peeling_is_one_short_pass(spark):
    """Sketches of a pair's own size give all keys in one step less than they have subtables, and fingerprints move their paragraphs once."""
    side = lambda lo, hi, n: spark.range(lo, hi).selectExpr("1L AS __rid", "1 AS pair", f"{32 * 8192}L AS cells", f"{n}L AS n", "xxhash64(id) AS key")
    keys = side(0, 3000, 1).unionByName(side(1000, 5000, -1)).repartition(2, "__rid")
    peeled = sketch.peel(sketch.sketches(keys, sketch.OWN_TABLES, "__rid", "pair"), sketch.OWN_TABLES)
    assert [(r["left"], r["differ"]) for r in peeled.collect()] == [(0, 3000)]
    assert peeled._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 3
    full = side(0, 3000, 1).selectExpr("__rid", "pair", "8L AS cells", "n", "key")
    assert [r["left"] > 0 for r in sketch.peel(sketch.sketches(full, 3, "__rid", "pair"), 3).collect()] == [True]
    rows = spark.createDataFrame([(1, [1, 2], [2, 3])], "__rid long, a array<long>, b array<long>")
    assert sketch.fingerprint(rows)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
