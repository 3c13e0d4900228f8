"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are scaled to unit length, rotated at random and dealt to lists by their nearest centre; there are as many lists as the
square root of the number of vectors. A query first scans its own list, which gives it a bound (the distance of the last of its nearest
so far), and takes the bound along to the other lists it probes. Within a list, distances are summed up over blocks of rotated columns; after
each block a hypothesis test (the partial sum, scaled up to all dimensions, against the bound with its allowance for the dimensions
unseen) abandons the candidates that are not among the nearest any more, and rows that are measured to the end tighten the bound for the rest.
What is left is scored exactly.

Equal vectors are one candidate with its few smallest ids: a later id of the same vector can't be among the nearest,
as ties go to smaller ids. Lists and their queries are met in cells of bounded size, so a list that holds a third of
all vectors becomes many cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

LISTS = 4_096  # lists at most; beyond that the lists' cells grow in number
SAMPLE = 16  # vectors for each list that the centres and the probing depth are fitted on ...
LEAST = 16_384  # ... but so many at least, if there are: at most LISTS x SAMPLE reach the driver
CELL = 4_096  # vectors of a list in one cell
QUERIES = 4_096  # queries of a list in one cell; only with more are its vectors repeated
ROWS = 256  # rows of a cell that are scanned before bounds are tightened
BLOCK = 8  # columns of a block
EPSILON = 2.1  # allowance of the test, in 1 / sqrt(dimensions seen)


def centres(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def probing_depth(sample: np.ndarray, c: np.ndarray, top: int, recall: float) -> int:
    """The fewest lists to probe that find this share of the nearest within the sample."""
    asked = sample[:: max(1, len(sample) // 400)][:400]
    near = np.argsort(-(asked @ sample.T), axis=1)[:, 1 : top + 1]
    home = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
    order = np.argsort(np.argsort(-(asked @ c.T), axis=1), axis=1)
    depth = np.sort(order[np.arange(len(asked))[:, None], home[near]].ravel())
    return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))))]) + 1 if len(depth) else 1


def _first(q: np.ndarray, dist: np.ndarray, ties: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n smallest ``dist`` of each q, smaller ``ties`` first among equals."""
    order = np.lexsort((ties, dist.round(12), q))
    own = q[order]
    start = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1]) if len(own) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
    return order[place < n]


def scan(x: np.ndarray, ids: np.ndarray, q: np.ndarray, bound: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``x`` (rotated unit vectors) that may be among the ``top`` nearest of each row of ``q``: (query, row, squared distance).
    ``bound``: what each query knows already (infinite: nothing). Pairs that the test abandons aren't measured further."""
    d = x.shape[1]
    bound = bound.copy()
    best = np.full((len(q), top), np.inf)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(x), ROWS):
        rows = x[at : at + ROWS]
        part = ((q[:, None, :BLOCK] - rows[None, :, :BLOCK]) ** 2).sum(axis=2) if BLOCK * len(q) * len(rows) <= 1 << 22 else _between(q[:, :BLOCK], rows[:, :BLOCK])
        seen = min(BLOCK, d)
        limit = _limit(bound, seen, d)
        a, b = np.nonzero(part <= limit[:, None])
        part = part[a, b]
        while seen < d and len(a):
            block = slice(seen, min(seen + BLOCK, d))
            part = part + ((rows[b, block] - q[a, block]) ** 2).sum(axis=1)
            seen = block.stop
            keep = part <= _limit(bound, seen, d)[a]
            a, b, part = a[keep], b[keep], part[keep]
        if not len(a):
            continue
        few = _first(a, part, ids[at + b], top)
        a, b, part = a[few], b[few], part[few]
        kept.append((a, at + b, part))
        mine = np.full((len(q), top), np.inf)
        place = np.arange(len(a)) - np.searchsorted(a, a)  # a is sorted
        mine[a, place] = part
        best = np.sort(np.concatenate([best, mine], axis=1), axis=1)[:, :top]
        bound = np.minimum(bound, best[:, -1])
    a, b, part = (np.concatenate([k[i] for k in kept] or [np.zeros(0, dtype=np.int64 if i < 2 else float)]) for i in range(3))
    few = _first(a, part, ids[b] if len(b) else b, top)
    return a[few], b[few], part[few]


def _between(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows."""
    return np.maximum((q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T), 0.0)


def _limit(bound: np.ndarray, seen: int, d: int) -> np.ndarray:
    """What a partial sum over ``seen`` of d columns may be, with room for rounding."""
    allowed = bound * (seen / d) * (1 + EPSILON / np.sqrt(seen)) ** 2 if seen < d else bound
    return allowed + 1e-9


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, vector as doubles, for vectors that aren't null or zero and hold no null, NaN or infinity; with their
    number of dimensions, as vectors of unlike length are never compared."""
    v = F.transform(vector, lambda x: x.cast("double"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(ok).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 5, recall: float = 0.97, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``top`` largest cosines found for each query among all other rows, in
    double precision on the original vectors, ties to the smaller vec_id.

    Rows that take no part: see ``usable``. Rows that repeat an id and its vector count once; other columns are ignored. Vectors of
    different lengths are never compared: each length has an index of its own. The index is fitted on a sample by hash of the id, of at most
    ``LISTS`` x ``SAMPLE`` vectors; the number of lists probed is what finds ``recall`` of the nearest there. An
    empty table, or no usable query, gives an empty result."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    asked = queries.select(F.col(key).cast("long").alias("vec_id")).distinct()
    lengths = sorted(r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect())  # one row a length
    out = spark.createDataFrame([], RESULT)
    for d in lengths:
        own = _nearest(rows.filter(F.size("v") == d), asked, d, top, recall)
        out = own if d == lengths[0] else out.unionByName(own)
    return out


RESULT = "query_id long, rank int, vec_id long, score double"


def _nearest(base: DataFrame, ids: DataFrame, d: int, top: int, recall: float) -> DataFrame:
    spark = base.sparkSession
    # Equal vectors: the top + 1 smallest ids (a query may be one of them).
    smallest = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = base.distinct().withColumn("__r", smallest).filter(F.col("__r") <= top + 1)
    distinct, _ = written(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    lists = int(min(LISTS, max(1, round(distinct.count() ** 0.5))))
    sample = np.array([r["v"] for r in distinct.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(max(LEAST, SAMPLE * lists)).collect()]).reshape(-1, d)
    rotation = np.linalg.qr(np.random.default_rng(11).normal(size=(d, d)))[0]
    unit = _unit(sample) @ rotation
    c = centres(unit, lists)
    depth = probing_depth(unit, c, top, recall)
    sent = spark.sparkContext.broadcast((rotation, c))  # dimensions squared and lists x dimensions numbers

    def place(probes: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turn, mid = sent.value
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    near = np.argsort(-(_unit(_matrix(batch.column(0), d)) @ turn @ mid.T), axis=1, kind="stable")[:, :probes]
                    take = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
                    nth = np.tile(np.arange(near.shape[1], dtype=np.int32), len(near))
                    yield pa.RecordBatch.from_arrays([pa.array(near.reshape(-1).astype(np.int32)), pa.array(nth), batch.column(0).take(take), batch.column(1).take(take)], ["list", "nth", "v", "ids"])

        return run

    kind = "list int, nth int, v array<double>, ids array<long>"
    asked = ids.join(base.distinct(), "vec_id")
    asked_vectors = asked.groupBy("v").agg(F.min("vec_id").alias("q"))  # equal queries are asked once
    homes, _ = written(distinct.select("v", "ids").mapInArrow(place(1), kind).drop("nth"), "lists")
    probes, _ = written(asked_vectors.select("v", F.array("q").alias("ids")).mapInArrow(place(depth), kind).select("list", "nth", "v", F.col("ids")[0].alias("q")), "probes")
    cells = F.broadcast(homes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells")))  # one row a list

    def meet(have: pa.Table, ask: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if have.num_rows and ask.num_rows:
            v, qv = _matrix(have["v"].combine_chunks(), d), _matrix(ask["v"].combine_chunks(), d)
            own = have["ids"].combine_chunks()
            first = own.flatten().to_numpy()[_starts(own)]
            order = np.argsort(first, kind="stable")
            v, first = v[order], first[order]
            turn = sent.value[0]
            x, qx, bound = _unit(v) @ turn, _unit(qv) @ turn, ask["bound"].to_numpy()
            for at in range(0, len(qx), 256):
                a, b, dist = scan(x, first, qx[at : at + 256], bound[at : at + 256], top + 1)
                a = a + at
                score = (v[b] * qv[a]).sum(axis=1) / (np.linalg.norm(v[b], axis=1) * np.linalg.norm(qv[a], axis=1))
                found.append((ask["q"].to_numpy()[a], order[b], score, dist))
        if not found:
            return pa.table({"q": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64()), "dist": pa.array([], pa.float64())})
        q, b, score, dist = (np.concatenate([f[i] for f in found]) for i in range(4))
        return pa.table({"q": q, "ids": own.take(pa.array(b)), "score": score, "dist": dist})

    def met(asks: DataFrame) -> DataFrame:
        turns = asks.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("turns"))
        grid = F.broadcast(cells.join(turns, "list"))  # one row a list
        dealt = lambda by, n: F.pmod(F.xxhash64(by), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = homes.join(grid, "list").select("list", dealt("ids", "cells").alias("cell"), each("turns").alias("turn"), "ids", "v")
        right = asks.join(grid, "list").select("list", each("cells").alias("cell"), dealt("q", "turns").alias("turn"), "q", "v", "bound")
        by = ("list", "cell", "turn")
        found, _ = written(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "q long, ids array<long>, score double, dist double"), "near")
        return found

    home = met(probes.filter("nth = 0").withColumn("bound", F.lit(float("inf"))))
    known = home.groupBy("q").agg(F.sort_array(F.collect_list("dist")).alias("ds")).select("q", F.get("ds", F.lit(top)).alias("bound"))  # top + 1 rows a cell of one list
    others = probes.filter("nth > 0").join(known, "q", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    found = home.unionByName(met(others)) if depth > 1 else home
    each = found.select("q", "score", F.explode("ids").alias("vec_id"))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    few_found = each.withColumn("__r", best).filter(F.col("__r") <= 2 * (top + 1)).drop("__r")
    shared = asked.join(asked_vectors, "v").select(F.col("vec_id").alias("query_id"), "q")
    mine = few_found.join(shared, "q").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return mine.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _unit(v: np.ndarray) -> np.ndarray:
    """Scaled to length one; by the largest component first, so that no square runs over."""
    v = v / np.abs(v).max(axis=1, keepdims=True, initial=1e-300)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _starts(column: pa.Array) -> np.ndarray:
    offsets = column.offsets.to_numpy()
    return offsets[:-1] - offsets[0]


def op3_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(e, e.filter("vec_id % 50 = 0"))
