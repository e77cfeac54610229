"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import Workspace, lean, text_rows

#: n-gram sizes, hash buckets, most training documents of each label, n-grams kept, characters per numpy block.
SIZES, BITS, SAMPLE, KEPT, STRETCH = (3, 4, 5, 6), 20, 2000, 4096, 1 << 20
#: Highest score of a model that was fitted on no rows of both labels.
UNTOLD = 0.49
_FACTOR, _SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _hits(codes: np.ndarray, wanted: np.ndarray | None):
    """For each n-gram size: n, positions and buckets of the n-grams that are wanted (all, if None)."""
    h = codes * _SPREAD
    for n in range(2, SIZES[-1] + 1):
        if len(codes) < n:
            return
        h = h[:-1] * _FACTOR + codes[n - 1 :]
        if n in SIZES:
            bucket = ((h * _SPREAD) ^ np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) >> np.uint32(32 - BITS)
            at = np.arange(len(bucket)) if wanted is None else np.flatnonzero(wanted[bucket])
            yield n, at, bucket[at]


def features(text: str) -> np.ndarray:
    """The distinct n-gram buckets of a whole text."""
    codes, out = _codes(text), [np.zeros(0, np.uint32)]
    for a in range(0, len(codes), STRETCH):
        out.append(np.unique(np.concatenate([np.zeros(0, np.uint32), *(b for _, _, b in _hits(codes[a : a + STRETCH + SIZES[-1] - 1], None))])))
    return np.unique(np.concatenate(out))


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Of whole texts, each n-gram counting once in a text."""
        wanted = np.zeros(1 << BITS, bool)
        wanted[self.buckets] = True
        weight = np.zeros(1 << BITS)
        weight[self.buckets] = self.weights
        total = np.full(len(texts), self.bias)
        codes = [_codes(t) for t in texts]
        ends = np.cumsum([len(c) for c in codes], dtype=np.int64)
        joined = np.concatenate([np.zeros(0, np.uint32), *codes])
        found = [np.zeros(0, np.int64)]
        for a in range(0, len(joined), STRETCH):
            for n, at, bucket in _hits(joined[a : a + STRETCH + SIZES[-1] - 1], wanted):
                doc = np.searchsorted(ends, at + a, side="right")
                inside = (at + a + n <= ends[doc]) & (at < STRETCH)
                found.append(np.unique(doc[inside] << BITS | bucket[inside].astype(np.int64)))
        pairs = np.unique(np.concatenate(found))
        np.add.at(total, pairs >> BITS, weight[pairs & ((1 << BITS) - 1)])
        return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, text) of at most sample labelled documents of each label, the first by a hash of the id; and how many training rows each label has.

    Labelled rows whose crc32 of the id as text is divisible by 5 are held out.
    """
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    counted = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    none, toxic = (known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1))
    # At most twice the sample of pairs of numbers.
    return text_rows(docs).join(F.broadcast(none.unionByName(toxic)), "doc_id").select("doc_id", "toxic", "text"), counted


def gram_counts(rows: DataFrame) -> DataFrame:
    """(bucket, n0, n1): texts of each label that have an n-gram of the bucket; bucket -1 counts all texts. Each partition sums up first."""

    def run(batches):
        seen, texts = np.zeros((2, 1 << BITS), np.int32), [0, 0]
        for batch in batches:
            for k, text in zip(batch.column("toxic").to_pylist(), batch.column("text"), strict=True):
                seen[k, features(text.as_py())] += 1
                texts[k] += 1
        at = np.flatnonzero(seen.any(0))
        for a in range(0, len(at), 1 << 16):
            own = at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(pa.array(seen[k, own].astype(np.int64)) for k in (0, 1))], ["bucket", "n0", "n1"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *(pa.array([n], pa.int64()) for n in texts)], ["bucket", "n0", "n1"])

    counts = rows.select("toxic", "text").mapInArrow(lean(run), "bucket int, n0 long, n1 long")
    return counts.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def telling(counts: DataFrame, n0: int, n1: int, kept: int = KEPT) -> DataFrame:
    """(bucket, n0, n1) of the n-grams whose shares of the two labels' texts differ most, by a z score over 4; at most so many."""
    rates = [(F.col(c) + 0.5) / (n + 1) for c, n in (("n0", n0), ("n1", n1))]
    both = (F.col("n0") + F.col("n1")) / F.lit(float(n0 + n1))
    z = F.abs(rates[1] - rates[0]) / F.sqrt(both * (1 - both) * (1 / n0 + 1 / n1) + 1e-12)
    enough = counts.where((F.col("bucket") >= 0) & (F.col("n0") + F.col("n1") >= min(8, (n0 + n1) / 4))).withColumn("z", z)
    return enough.where("z > 4").orderBy(F.desc("z"), "bucket").limit(kept).select("bucket", "n0", "n1")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most sample labelled documents of each label (see training_rows).

    n-grams are counted by label, and the most telling chosen, in Spark. To the driver come
    those, KEPT at most, and two bytes for each that a training text has. The log-count ratio
    of an n-gram scales its presence. The bias is set to the labels' true proportion, counted
    over all training rows. Without training rows of both labels the model is a constant under
    0.5: it tells no text from another, so it rejects none.
    """
    work = Workspace(docs.sparkSession)
    rows, counted = training_rows(docs, labels, sample)
    rows = work.put(rows, "training")
    counts = work.put(gram_counts(rows), "grams")
    total = counts.where("bucket = -1").first()
    share = (counted.get(1, 0) + 0.5) / (sum(counted.values()) + 1)
    if total is None or not total["n0"] or not total["n1"]:
        share = min(share, UNTOLD)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    n = total["n0"], total["n1"]
    chosen = sorted((r["bucket"], r["n0"], r["n1"]) for r in telling(counts, *n).collect())
    kept, *seen = (np.array([c[k] for c in chosen], np.int64) for k in range(3))
    ratio = np.log((seen[1] + 0.5) / (n[1] + 1) / ((seen[0] + 0.5) / (n[0] + 1)))

    def run(batches):
        at = np.full(1 << BITS, -1)
        at[kept] = np.arange(len(kept))
        for batch in batches:
            own = [at[features(t.as_py())] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([x[x >= 0].astype("<u2").tobytes() for x in own], pa.binary())], ["doc_id", "toxic", "grams"])

    held = rows.mapInArrow(lean(run), "doc_id long, toxic int, grams binary").orderBy("doc_id", "grams").collect()
    y = np.array([r["toxic"] for r in held], float)
    x = np.zeros((len(y), len(kept)), np.float32)
    for k, r in enumerate(held):
        own = np.frombuffer(r["grams"], "<u2")
        x[k, own] = ratio[own]
    work.drop(rows, counts)
    w, b = fit(x, y)
    odds = np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return Model(kept, w * ratio, float(b + odds))


def fit(x: np.ndarray, y: np.ndarray, l2: float = 2e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with a squared penalty, by accelerated gradient descent with a safe step."""
    n, d = x.shape
    v = np.ones(d, np.float32)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * (float(np.linalg.norm(x @ v)) ** 2 / n + 1) + l2)
    w = last = np.zeros(d, np.float32)
    b = last_b = 0.0
    for k in range(steps):
        m = k / (k + 3)
        u, c = w + m * (w - last), b + m * (b - last_b)
        e = ((1 / (1 + np.exp(-np.clip(x @ u + c, -60, 60)))) - y).astype(np.float32)
        last, last_b = w, b
        w, b = u - step * (x.T @ e / n + l2 * u), c - step * float(e.mean())
    return w.astype(float), b


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The table with its own columns and toxicity double, 0 to 1, of each whole text; null is the empty text, whose score is the bias's."""
    buckets, weights, bias = model.buckets, model.weights, model.bias
    name = "toxicity"
    while name in docs.columns:
        name += "_"

    def run(batches):
        own = Model(buckets, weights, bias)
        for batch in batches:
            got = np.zeros(batch.num_rows)
            column = batch.column(batch.schema.names.index("text"))
            held, size, first = [], 0, 0
            for k in range(batch.num_rows):
                held.append(column[k].as_py() or "")
                size += len(held[-1])
                if size >= STRETCH or k == batch.num_rows - 1:
                    got[first : k + 1] = own.scores(held)
                    held, size, first = [], 0, k + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*batch.schema.names, name])

    schema = type(docs.schema)([*docs.schema.fields]).add(name, "double")
    return docs.mapInArrow(lean(run), schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is under the threshold, with their own columns. The model is trained on the labelled documents, by default the same table."""
    scored = score(docs, train(docs if labelled is None else labelled, labels))
    return scored.where(F.col(scored.columns[-1]) < threshold).select(*docs.columns)
