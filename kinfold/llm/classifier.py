"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 of low quality, 2 good. One weight vector over hashed text features is shared by all grades;
ordered thresholds t0 < t1 cut its score s: P(grade <= k) = logistic(t_k - s). A document gets its expected grade
and the tail probability P(grade >= 2), and is kept if that tail is high enough.

The model is fitted on a bounded sample of labelled rows: ``PER_GRADE`` of each grade at most, those with the
smallest hash of doc_id. As the bound changes the mix of the grades, each example counts as many times as its grade has
labels to a sampled one. Everything is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PER_GRADE = 3000
GRADES = 3
SPACE = (1 << 26) - 1  # hashed feature numbers
STRIP = ".,;:!?|*%$#&<>()[]{}\"'"
MEMO = 50_000  # words of which a worker remembers the features


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & SPACE


def word_features(word: str) -> tuple[int, ...]:
    """Of one lower-cased word: itself without outer punctuation, and its first five letters if it has more."""
    bare = word.strip(STRIP)
    if len(bare) > 5:
        return _hash("w" + bare), _hash("p" + bare[:5])
    return (_hash("w" + bare),) if bare else ()


def shape_features(text: str, words: list[str], distinct: int) -> list[int]:
    """Of a whole text: shares of upper-case words, symbols and new words, in coarse steps."""
    if not words:
        return [_hash("empty")]
    n = len(words)
    upper = sum(map(str.isupper, words)) * 8 // n
    marks = min(8, sum(map(text.count, "#*$%&|<>!")) * 40 // max(1, len(text)))
    size = min(6, n.bit_length() // 2)
    return [_hash(f"upper {upper}"), _hash(f"marks {marks}"), _hash(f"new {size} {distinct * 8 // n}")]


def features(text: str) -> set[int]:
    """Which features a text has; how often doesn't matter."""
    words = text.split()
    own = set(text.lower().split())
    out = set(shape_features(text, words, len(own)))
    for w in own:
        out.update(word_features(w))
    return out


@dataclass(frozen=True)
class OrdinalModel:
    """Weights of the features that have one, and the two thresholds."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (-30.0, -20.0)  # of the untrained model: everything is of the top grade

    def at_most(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for k = 0, 1; a row a score."""
        return 1 / (1 + np.exp(np.clip(score[:, None] - np.array(self.thresholds)[None, :], -60, 60)))


def fit(rows: list[np.ndarray], grade: np.ndarray, weight: np.ndarray | None = None, *, seen: int = 5, strong: float = 4.0, penalty: float = 2.0, steps: int = 200) -> OrdinalModel:
    """rows: the feature numbers of each example; weight: how much each counts in the likelihood, one unless said. Features in under ``seen`` examples, or whose counts by grade are
    within ``strong`` standard deviations of chance, get no weight. The rest is penalised maximum likelihood by
    gradient steps (Adam). With fewer than two grades there is nothing to learn and the untrained model comes back."""
    present = np.unique(grade)
    if len(present) < 2:
        return OrdinalModel()
    lengths = np.array([len(r) for r in rows])
    flat, doc = np.concatenate(rows), np.repeat(np.arange(len(rows)), lengths)
    names, index, count = np.unique(flat, return_inverse=True, return_counts=True)
    odd = np.zeros(len(names))
    for g in present:
        share = (grade == g).mean()
        have = np.bincount(index, weights=(grade == g)[doc].astype(float), minlength=len(names))
        odd = np.maximum(odd, np.abs(have - count * share) / np.sqrt(count * share * (1 - share)))
    good = (count >= seen) & (odd >= strong)
    column = np.cumsum(good) - 1
    use = good[index]
    index, doc, names = column[index[use]], doc[use], names[good]
    n, k = len(rows), len(names)
    w = np.ones(n) if weight is None else weight * (n / weight.sum())  # of mean one, so that the penalty keeps its strength
    x = np.concatenate([np.zeros(k), [-1.0, 0.7]])  # weights, first threshold, log of the step to the second
    m, v = np.zeros_like(x), np.zeros_like(x)
    rate = 0.1
    for step in range(1, steps + 1):
        s = np.bincount(doc, weights=x[index] if k else None, minlength=n) if k else np.zeros(n)
        t0 = x[k]
        t1 = t0 + np.exp(x[k + 1])
        a, b = 1 / (1 + np.exp(np.clip(s - t0, -60, 60))), 1 / (1 + np.exp(np.clip(s - t1, -60, 60)))
        da, db = a * (1 - a), b * (1 - b)
        p = np.maximum(np.choose(grade, [a, b - a, 1 - b]), 1e-12)
        up0, up1 = w * np.choose(grade, [da, -da, 0 * da]) / p, w * np.choose(grade, [0 * db, db, -db]) / p  # of the log-likelihood by t0, t1
        g = np.zeros_like(x)
        if k:
            g[:k] = np.bincount(index, weights=(up0 + up1)[doc], minlength=k) + penalty * x[:k]
        g[k], g[k + 1] = -(up0 + up1).sum(), -up1.sum() * np.exp(x[k + 1])
        g /= n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    t1 = x[k] + np.exp(x[k + 1])
    return OrdinalModel(dict(zip(names.tolist(), x[:k].tolist(), strict=True)), (float(x[k]), float(t1)))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade. Repeated labels of a document count as the worst of them; null marks as 0, rows without
    doc_id are left out."""
    one = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.coalesce("quality", F.lit(0))).alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    return one.select("doc_id", F.when(F.col("toxic") > 0, 0).when(F.col("quality") <= 0, 1).otherwise(2).alias("grade"))


def examples(docs: DataFrame, labels: DataFrame, per_grade: int = PER_GRADE) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Features, grades and weights of the sample: at most 3 x ``per_grade`` documents reach the driver, as feature numbers.
    A weight is how many labelled documents of its grade there are to a sampled one; one where the bound leaves all."""
    rated = graded(labels).join(docs.select("doc_id"), "doc_id", "left_semi")
    share = np.ones(GRADES)
    for r in rated.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect():
        share[r.grade] = max(r.n / per_grade, 1.0)
    first = lambda g: rated.filter(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade)
    known = first(0).unionByName(first(1)).unionByName(first(2))
    chosen = docs.select("doc_id", "text").join(F.broadcast(known.select("doc_id", "grade")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.fromiter(features(t.as_py() or ""), dtype=np.int32).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1), batch.column(2)], ["f", "grade", "doc_id"])

    got = chosen.select(F.col("text").cast("string"), F.col("grade").cast("int"), F.col("doc_id").cast("long")).mapInArrow(run, "f binary, grade int, doc_id long").toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")  # the same order whatever the tasks', so the same model
    rows = [np.frombuffer(b, dtype=np.int32) for b in got["f"].to_pylist()]
    grade = got["grade"].to_numpy()[order]
    return [rows[i] for i in order], grade, share[grade]


def train(docs: DataFrame, labels: DataFrame, per_grade: int = PER_GRADE) -> OrdinalModel:
    rows, grade, weight = examples(docs, labels, per_grade)
    return fit(rows, grade, weight) if rows else OrdinalModel()


def _scores(texts: pa.Array, model: OrdinalModel, known: dict[str, tuple[int, ...]]) -> np.ndarray:
    """The score of each text. ``known`` remembers the weighted features of at most ``MEMO`` words."""
    weights = model.weights
    out = np.zeros(len(texts))
    for i, value in enumerate(texts):
        t = value.as_py() or ""
        words = t.split()
        distinct = set(t.lower().split())
        have = {f for f in shape_features(t, words, len(distinct)) if f in weights}
        if len(known) > MEMO:
            known.clear()
        for w in distinct:
            found = known.get(w)
            if found is None:
                found = tuple(f for f in word_features(w) if f in weights)
                if len(w) <= 64:
                    known[w] = found
            if found:
                have.update(found)
        out[i] = sum(weights[f] for f in sorted(have))
    return out


def score(df: DataFrame, model: OrdinalModel, keep: float = 0.5, text: str = "text") -> DataFrame:
    """``df`` with expected_grade, p_toxic (P(grade = 0)), p_good (P(grade >= 2)) and kept (p_good >= ``keep``).
    Columns of these names are replaced. A null text counts as empty, equal texts get equal scores, rows that repeat stay,
    an empty table gives an empty result. Only texts go to the workers and only four numbers come back: the other
    columns stay with Spark. The function counts as not deterministic, so that a filter above runs it once."""
    added = ("expected_grade", "p_toxic", "p_good", "kept")
    spread = df.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # as many weights as the bounded sample has strong features

    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = OrdinalModel(*spread.value)
        known: dict[str, tuple[int, ...]] = {}
        for texts in batches:
            low = own.at_most(_scores(texts, own, known))
            p_good = 1 - low[:, 1]
            yield pa.StructArray.from_arrays([pa.array(2 - low[:, 0] - low[:, 1]), pa.array(low[:, 0]), pa.array(p_good), pa.array(p_good >= keep)], list(added))

    judge = F.arrow_udf(judged, "expected_grade double, p_toxic double, p_good double, kept boolean").asNondeterministic()
    rows = df.drop(*added)
    return rows.withColumn("__judged", judge(F.col(text).cast("string"))).select(*rows.columns, *[F.col(f"__judged.{c}").alias(c) for c in added])


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade, tail probability and verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "expected_grade", "p_toxic", "p_good", "kept")
