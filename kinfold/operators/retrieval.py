"""Dense and sparse retrieval, and what it adds to blocking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def knn_sql(queries: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """Exact top-k inner product within a group: qid, cid, score, rank. queries: qid, grp, v; pool: cid, grp, v. A join of all
    pairs of a group: for small tables and as the plain form of ``knn``."""
    both = queries.select("qid", "grp", F.col("v").alias("q")).join(pool.select("cid", "grp", F.col("v").alias("c")), "grp")
    score = F.aggregate(F.zip_with("q", "c", lambda a, b: a * b), F.lit(0).cast(_element(queries)), lambda t, x: t + x)
    return _top(both.select("qid", "cid", score.alias("score")), k)


def _element(df: DataFrame) -> str:
    return df.schema["v"].dataType.elementType.simpleString()


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "cid"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def knn(queries: DataFrame, pool: DataFrame, k: int, block: int = 1024, cell: int = 8192) -> DataFrame:
    """The same by blocks: queries and pool of a group are dealt into cells of about these sizes, each pair of cells
    is one matrix product that keeps its k best, and the best of those are merged. Scores in double precision (exact for
    whole numbers below 2**53). No cell grows with a group."""
    size = lambda df, n, out: df.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(out))
    grid = size(queries, block, "nq").join(size(pool, cell, "nc"), "grp")
    left = queries.join(grid, "grp").select("grp", F.pmod(F.xxhash64("qid"), F.col("nq")).cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.col("nc") - 1)).alias("b"), "qid", "v")
    right = pool.join(grid, "grp").select(F.col("grp").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("a"), F.pmod(F.xxhash64("cid"), F.col("nc")).cast("int").alias("b"), "cid", F.col("v").alias("v"))

    def product(q, c):
        import pandas as pd

        if not len(q) or not len(c):
            return pd.DataFrame({"qid": q["qid"][:0], "cid": c["cid"][:0], "score": np.empty(0)})
        c = c.sort_values("cid", kind="stable")
        s = np.stack(q["v"].to_numpy()).astype(float) @ np.stack(c["v"].to_numpy()).astype(float).T
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"qid": np.repeat(q["qid"].to_numpy(), best.shape[1]), "cid": c["cid"].to_numpy()[best.ravel()], "score": np.take_along_axis(s, best, 1).ravel()})

    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, cid {pool.schema['cid'].dataType.simpleString()}, score double"
    return _top(left.groupBy("grp", "a", "b").cogroup(right.groupBy("grp", "a", "b")).applyInPandas(product, kinds), k)


def hashed_embedding(records: DataFrame, text: str, dims: int = 256) -> DataFrame:
    """Adds ``v``: unit vectors of hashed character trigrams, the encoder used where no trained one is plugged in."""
    names = [*records.columns, "v"]
    at = records.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            out = np.zeros((batch.num_rows, dims), dtype=np.float32)
            for i, t in enumerate(batch.column(at).to_pylist()):
                s = f" {t or ''} "
                for j in range(len(s) - 2):
                    h = zlib.crc32(s[j : j + 3].encode())
                    out[i, h % dims] += 1 if h & 0x80000000 else -1
                n = np.linalg.norm(out[i])
                out[i] /= n or 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(out), pa.list_(pa.float32()))], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema)
    return records.mapInArrow(run, f"{schema}, v array<float>")


def with_ann(pairs: DataFrame, ann: DataFrame, candidates: DataFrame, k: int) -> dict[str, DataFrame]:
    """known: pairs with their retrieval score (null outside the list); extra: retrieved pairs, rank up to k, that blocking
    never made (p = 0); alone: the retrieved ones by themselves. pairs: s1_id, cand_id, p; ann: s1_id, cand_id, ann_score, ann_rank."""
    ids = ["s1_id", "cand_id"]
    own = ann.join(pairs.select("s1_id").distinct(), "s1_id", "left_semi")
    top = own.groupBy("s1_id").agg(F.max("ann_score").alias("ann_top"))
    near = own.filter(F.col("ann_rank") <= k)
    gap = (F.col("ann_top") - F.col("ann_score")).alias("ann_gap")
    columns = lambda p, blocked: [*ids, p, "ann_score", "ann_rank", F.lit(blocked).alias("in_blocked"), "ann_top", gap]
    return {
        "known": pairs.select(*ids, "p").join(own, ids, "left").join(top, "s1_id", "left").select(*columns(F.col("p"), 1)),
        "extra": near.join(candidates.select(*ids), ids, "left_anti").join(top, "s1_id").select(*columns(F.lit(0.0).alias("p"), 0)),
        "alone": near.join(top, "s1_id").select(*columns(F.col("ann_score").alias("p"), 0)),
    }


def with_original(rows: DataFrame, ann: DataFrame) -> DataFrame:
    """Adds o_score, o_rank and o_gap: what a second encoder's search says of each pair (null outside its list; the gap is to the
    best of the record's list). rows: s1_id, cand_id, ...; ann: s1_id, cand_id, ann_score, ann_rank."""
    ids = ["s1_id", "cand_id"]
    top = ann.groupBy("s1_id").agg(F.max("ann_score").alias("__top"))
    own = ann.select(*ids, F.col("ann_score").alias("o_score"), F.col("ann_rank").alias("o_rank"))
    return rows.join(own, ids, "left").join(top, "s1_id", "left").withColumn("o_gap", F.col("__top") - F.col("o_score")).drop("__top").select(*rows.columns, "o_score", "o_rank", "o_gap")


def recall_of(ann: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 10)) -> DataFrame:
    """One row: n (records with a match) and recall_k, the share of them with a match among their k nearest."""
    best = truth.join(ann.select("s1_id", "cand_id", "ann_rank"), ["s1_id", "cand_id"], "left").groupBy("s1_id").agg(F.min("ann_rank").alias("r"))
    return best.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg((F.coalesce("r", F.lit(1 << 30)) <= k).cast("double")), 6).alias(f"recall_{k}") for k in ks])


def gate_report(truth: DataFrame, blocked: DataFrame, ann: DataFrame, k: int, ids: DataFrame) -> DataFrame:
    """source (blocked, retrieved, either), pairs, found, recall and ceiling_f05 (macro F0.5 of a perfect choice among the pairs), and for ``either`` how many
    pairs retrieval adds. ids: s1_id of all records."""
    pair = ["s1_id", "cand_id"]
    near = ann.filter(F.col("ann_rank") <= k).select(*pair)
    added = near.join(blocked.select(*pair), pair, "left_anti")
    rows = None
    for name, pairs in (("blocked", blocked.select(*pair).distinct()), ("retrieved", near.distinct()), ("either", blocked.select(*pair).unionByName(near).distinct())):
        hits = truth.join(pairs, pair, "left_semi").groupBy("s1_id").agg(F.count(F.lit(1)).alias("h"))
        each = ids.join(truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("m")), "s1_id", "left").join(hits, "s1_id", "left").na.fill(0, ["m", "h"])
        ceiling = F.when(F.col("m") == 0, 1.0).when(F.col("h") == 0, 0.0).otherwise(1.25 * F.col("h") / (F.col("h") + 0.25 * F.col("m")))
        own = each.agg(F.sum("h").alias("found"), F.round(F.sum("h") / F.nullif(F.sum("m"), F.lit(0)), 6).alias("recall"), F.round(F.avg(ceiling), 6).alias("ceiling_f05"))
        n = pairs.agg(F.count(F.lit(1)).alias("pairs"))
        extra = added.agg(F.count(F.lit(1)).alias("added")) if name == "either" else added.sparkSession.range(1).select(F.lit(0).cast("long").alias("added"))
        row = own.crossJoin(n).crossJoin(extra).select(F.lit(name).alias("source"), "pairs", "found", "recall", "ceiling_f05", "added")  # one row each
        rows = row if rows is None else rows.unionByName(row)
    return rows


def gate(truth: DataFrame, blocked: DataFrame, ann: DataFrame, k: int) -> DataFrame:
    """One row: true pairs found by blocking, by retrieval, by both, by either."""
    ids = ["s1_id", "cand_id"]
    flag = lambda df, out: df.select(*ids).distinct().withColumn(out, F.lit(1))
    hit = truth.join(flag(blocked, "d"), ids, "left").join(flag(ann.filter(F.col("ann_rank") <= k), "a"), ids, "left").na.fill(0, ["d", "a"])
    return hit.agg(F.count(F.lit(1)).alias("n_true"), F.sum("d").alias("blocked"), F.sum("a").alias("retrieved"), F.sum(F.col("d") * F.col("a")).alias("both"), F.sum(F.greatest("d", "a")).alias("either"))


def _gram_weights(queries: DataFrame, pool: DataFrame, total: int, lo: int, hi: int, max_df: int | None) -> tuple[DataFrame, DataFrame]:
    """qid, g, w and cid, g, w: counts of character n-grams x ln(1 + total / df) in millionths; grams that the pool lacks weigh nothing."""
    grams = lambda df, key: df.select(F.col("id").alias(key), F.explode("tokens").alias("t")).select(key, F.explode(T.char_ngrams(F.col("t"), lo, hi)).alias("g")).groupBy(key, "g").agg(F.count(F.lit(1)).alias("tf"))
    c, q = grams(pool, "cid"), grams(queries, "qid")
    stats = c.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    if max_df:
        stats = stats.filter(F.col("df") <= max_df)
    stats = stats.withColumn("idf", T.micro_idf(total, F.col("df")))
    weighed = lambda df, key: df.join(stats, "g").select(key, "g", (F.col("tf") * F.col("idf")).alias("w"))
    return weighed(q, "qid"), weighed(c, "cid")


GRAMS = 1_000_000  # grams that tasks get the weights of; words of a-z and 0-9 have fewer of 2 to 4 letters in practice, and more are dealt to the cells with the records


def tfidf_top(queries: DataFrame, pool: DataFrame, total: int, top: int = 25, least: float = 0.05, lo: int = 2, hi: int = 4, max_df: int | None = None, block: int = 4096, cell: int = 32768, known: int = GRAMS) -> DataFrame:
    """Sparse cosine of character n-grams: qid, cid, score, rank, scores over ``least``. queries, pool: id, tokens. Grams in over ``max_df`` pool
    records can be left out.

    Nearly all names share some short gram, so a join on grams makes more rows than there are pairs. Here blocks of queries meet cells of the
    pool: a cell's grams are an inverted index in arrays and each cell keeps a query's best. Only words are dealt to the
    cells, which cut them into grams themselves and get the weights of all grams; of more than ``known`` grams each record brings its own. Weights are whole
    millionths, so sums are exact in 64 bits in any order (records of some hundred grams at most).

    Records of the same words are one class, by its smallest id, and meet the cells once; as each class has a record, a query's ``top`` best classes hold its ``top`` best records.
    A query is weighed against a cell nearly, and exactly where that could put a record among its best. With a high ``least`` only its rare grams are added up: what the others can still
    add is bounded by their norm."""
    whole = lambda df, key: df.groupBy(F.col("id").alias(key)).agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    same = Window.partitionBy("tokens")
    named = lambda df, key: whole(df, key).select(key, "tokens", F.min(key).over(same).alias("of"), F.count(F.lit(1)).over(same).alias("n"))
    asked, held = named(queries, "qid"), named(pool, "cid")
    left, right = asked.filter("qid = of").select("qid", "tokens"), held.filter("cid = of").select("cid", "tokens", "n")
    each = right.select("n", F.explode(F.array_distinct(F.flatten(F.transform(F.filter("tokens", lambda t: t.isNotNull()), lambda t: T.char_ngrams(t, lo, hi))))).alias("g"))
    stats = each.groupBy("g").agg(F.sum("n").alias("df"))
    if max_df:
        stats = stats.filter(F.col("df") <= max_df)
    weights = stats.select("g", T.micro_idf(total, F.col("df")).alias("idf")).limit(known + 1).toArrow() if total > 0 else pa.table({"g": pa.array([], pa.string()), "idf": pa.array([], pa.int64())})
    if weights.num_rows > known:
        return _tfidf_dealt(queries, pool, total, top, least, lo, hi, max_df, block // 8, cell // 8)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, weights.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(weights)
    packed = sink.getvalue().to_pybytes()

    def meet(q, c):
        import pandas as pd

        none = pd.DataFrame({"qid": q["qid"][:0], "cid": c["cid"][:0], "dot": np.empty(0), "n": np.empty(0)})
        if not len(q) or not len(c):
            return none
        read = pa.ipc.open_stream(packed).read_all()
        at = {g: i for i, g in enumerate(read.column(0).to_pylist())}
        idf = read.column(1).to_numpy().astype(np.int64)
        words: dict[str, np.ndarray] = {}

        def cut(t):
            if t not in words:
                p = f" {t} "
                own = (at.get(p[i : i + n]) for n in range(lo, hi + 1) for i in range(len(p) - n + 1))
                words[t] = np.array([x for x in own if x is not None], dtype=np.int64)
            return words[t]

        def vectors(column):
            """Rows, grams and weights, in order of the rows and then of the grams, and each row's norm."""
            parts = [[cut(t) for t in tokens if t is not None] for tokens in column]
            sizes = np.array([sum(map(len, own)) for own in parts], dtype=np.int64)
            flat = [x for own in parts for x in own]
            key = np.repeat(np.arange(len(parts)), sizes) * len(idf) + (np.concatenate(flat) if flat else np.empty(0, dtype=np.int64))
            key, times = np.unique(key, return_counts=True)
            row, gram = np.divmod(key, max(1, len(idf)))
            weight = times * idf[gram]
            squares = np.zeros(len(parts) + 1, dtype=np.int64)
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            if len(row):
                squares[row[starts]] = np.add.reduceat(weight * weight, starts)
            return row, gram, weight, np.sqrt(squares[:-1].astype(float))

        c = c.sort_values("cid", kind="stable")
        row, gram, weight, norms = vectors(c["tokens"])
        own_gram, own_weight, own_ends = gram, weight, np.searchsorted(row, np.arange(len(c) + 1))
        order = np.argsort(gram, kind="stable")
        row, weight = row[order].astype(np.int32), weight[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(gram, minlength=len(idf)))])
        ids = c["cid"].to_numpy()
        norms[norms == 0] = np.inf  # of no gram: near to nothing
        q_row, q_gram, q_weight, q_norms = vectors(q["tokens"])
        q_ends = np.searchsorted(q_row, np.arange(len(q) + 1))
        out, keys = [], q["qid"].to_numpy()
        asks = np.zeros(max(1, len(idf)), dtype=np.int64)  # the weights of the query at hand

        def products(rows):
            """Of whole rows."""
            n = own_ends[rows + 1] - own_ends[rows]
            starts = np.cumsum(n) - n
            at_row = np.repeat(own_ends[rows] - starts, n) + np.arange(n.sum())
            return np.add.reduceat(asks[own_gram[at_row]] * own_weight[at_row], starts)

        # First nearly, in single precision: grams of many rows by a matrix product, the others by their postings. With a high ``least`` the rare grams decide.
        strict, sizes = least >= 0.5, np.diff(ends)
        common = np.flatnonzero(sizes > max(1, len(ids) // 16)) if not strict else np.empty(0, dtype=np.int64)
        place = np.full(max(1, len(idf)), -1)
        place[common] = np.arange(len(common))
        unit = (weight / norms[row]).astype(np.float32)
        dense = np.zeros((len(common), len(ids)), dtype=np.float32)
        for k, g in enumerate(common.tolist()):
            dense[k, row[ends[g] : ends[g + 1]]] = unit[ends[g] : ends[g + 1]]
        for i, key in enumerate(keys):
            if i % 128 == 0:
                part = slice(q_ends[i], q_ends[min(i + 128, len(keys))])
                many = place[q_gram[part]] >= 0
                asked = np.zeros((min(128, len(keys) - i), len(common)), dtype=np.float32)
                asked[q_row[part][many] - i, place[q_gram[part][many]]] = q_weight[part][many] / q_norms[q_row[part][many]]
                nearly = asked @ dense
            if q_ends[i] == q_ends[i + 1]:
                continue
            own, wants = q_gram[q_ends[i] : q_ends[i + 1]], q_weight[q_ends[i] : q_ends[i + 1]]
            near, left_out, some = nearly[i % 128], 0.0, place[own] < 0
            few, share = own[some], wants[some] / q_norms[i]
            if strict:
                rare = np.argsort(sizes[few], kind="stable")
                few, share = few[rare], share[rare]
                rest = np.sqrt(np.append(np.cumsum((share**2)[::-1])[::-1], 0.0))  # what the grams from each on can add to a score
                upto = int(np.searchsorted(-rest, -0.7 * least))
                few, share, left_out = few[:upto], share[:upto], rest[upto]
            for s, e, w in zip(ends[few].tolist(), ends[few + 1].tolist(), share.astype(np.float32), strict=True):
                near[row[s:e]] += w * unit[s:e]  # a gram names a record once
            enough = max(least, np.partition(near, len(near) - top)[len(near) - top]) if not strict and len(near) > top else least
            good = np.flatnonzero(near > enough - left_out - 1e-4)
            good = good[own_ends[good + 1] > own_ends[good]]
            if not len(good):
                continue
            asks[own] = wants
            dot = products(good)
            asks[own] = 0
            score = dot / (q_norms[i] * norms[good])
            best = np.flatnonzero(score > least - 1e-6)
            if len(best) > top:  # with those that rounding could make equal to the last
                best = best[score[best] >= np.partition(score[best], len(best) - top)[len(best) - top] - 1e-6]
            if len(best):
                out.append((key, ids[good[best]], dot[best].astype(float), q_norms[i] * norms[good[best]]))
        if not out:
            return none
        return pd.DataFrame({"qid": np.repeat(np.array([x[0] for x in out], dtype=keys.dtype), [len(x[1]) for x in out]), "cid": np.concatenate([x[1] for x in out]), "dot": np.concatenate([x[2] for x in out]), "n": np.concatenate([x[3] for x in out])})

    few = _met(left, right.drop("n"), ("tokens",), meet, block, cell, top, least).drop("rank").withColumnsRenamed({"qid": "of", "cid": "cand_of"})
    turn = F.row_number().over(Window.partitionBy("of").orderBy("cid"))
    members = held.select("of", "cid").withColumn("turn", turn).filter(F.col("turn") <= top).groupBy(F.col("of").alias("cand_of")).agg(F.collect_list("cid").alias("ids"))
    best = _top(few.join(members, "cand_of").select(F.col("of").alias("qid"), F.explode("ids").alias("cid"), "score"), top)
    lists = best.groupBy(F.col("qid").alias("of")).agg(F.collect_list(F.struct("cid", "score", "rank")).alias("list"))
    return asked.select("qid", "of").join(lists, "of").select("qid", F.explode("list").alias("x")).select("qid", "x.*")


def _met(left: DataFrame, right: DataFrame, fields: tuple[str, ...], meet, block: int, cell: int, top: int, least: float) -> DataFrame:
    """Blocks of ``left`` (qid and the fields) and cells of ``right`` (cid and the fields) by ``meet``, and each query's best of all cells."""
    sizes = left.agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nq")).crossJoin(right.agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("nc"))).filter("nq > 0 AND nc > 0")  # one row
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kinds = f"qid {left.schema['qid'].dataType.simpleString()}, cid {right.schema['cid'].dataType.simpleString()}, dot double, n double"
    left = left.crossJoin(F.broadcast(sizes)).select(dealt("qid", "nq").alias("i"), each("nc").alias("j"), "qid", *fields)
    right = right.crossJoin(F.broadcast(sizes)).select(each("nq").alias("i"), dealt("cid", "nc").alias("j"), "cid", *fields)
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(meet, kinds)
    return _top(found.select("qid", "cid", F.round(F.col("dot") / F.col("n"), 6).alias("score")).filter(F.col("score") > least), top)


def _tfidf_dealt(queries: DataFrame, pool: DataFrame, total: int, top: int = 25, least: float = 0.05, lo: int = 2, hi: int = 4, max_df: int | None = None, block: int = 1024, cell: int = 4096) -> DataFrame:
    """``tfidf_top`` where each record brings its weighed grams to the cells."""
    a, b = _gram_weights(queries, pool, total, lo, hi, max_df)
    listed = lambda df, key: df.groupBy(key).agg(F.collect_list(F.struct(F.xxhash64("g").alias("g"), "w")).alias("x"), F.sqrt(F.sum(F.col("w") * F.col("w")).cast("double")).alias("norm")).select(key, F.col("x.g").alias("g"), F.col("x.w").alias("w"), "norm")
    left, right = listed(a, "qid"), listed(b, "cid")

    def meet(q, c):
        import pandas as pd

        out = []
        if len(q) and len(c):
            c = c.sort_values("cid", kind="stable")
            size = c["g"].map(len).to_numpy()
            gram, weight, row = np.concatenate(c["g"].to_list()), np.concatenate(c["w"].to_list()), np.repeat(np.arange(len(c)), size)
            order = np.argsort(gram, kind="stable")
            gram, weight, row = gram[order], weight[order], row[order]
            ids, norms = c["cid"].to_numpy(), c["norm"].to_numpy()
            for key, gs, ws, norm in zip(q["qid"], q["g"], q["w"], q["norm"], strict=True):
                dot = np.zeros(len(c), dtype=np.int64)
                for s, e, w in zip(np.searchsorted(gram, gs, "left").tolist(), np.searchsorted(gram, gs, "right").tolist(), ws.tolist(), strict=True):
                    dot[row[s:e]] += w * weight[s:e]  # a gram names a record once
                score = dot / (norm * norms)
                good = np.flatnonzero(score > least - 1e-6)
                if len(good) > top:  # with those that rounding could make equal to the last
                    good = good[score[good] >= np.partition(score[good], len(good) - top)[len(good) - top] - 1e-6]
                out.append(pd.DataFrame({"qid": [key] * len(good), "cid": ids[good], "dot": dot[good].astype(float), "n": norm * norms[good]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": q["qid"][:0], "cid": c["cid"][:0], "dot": np.empty(0), "n": np.empty(0)})

    return _met(left, right, ("g", "w", "norm"), meet, block, cell, top, least)


def tfidf_join(queries: DataFrame, pool: DataFrame, total: int, top: int = 25, least: float = 0.05, lo: int = 2, hi: int = 4, max_df: int | None = None) -> DataFrame:
    """The same by a join on grams, in built-in functions: for rare grams (a low ``max_df``), and as the plain form of ``tfidf_top``."""
    a, b = _gram_weights(queries, pool, total, lo, hi, max_df)
    norm = lambda df, key, out: df.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w")).cast("double")).alias(out))
    dots = a.withColumnRenamed("w", "wq").join(b.withColumnRenamed("w", "wc"), "g").groupBy("qid", "cid").agg(F.sum(F.col("wq") * F.col("wc")).cast("double").alias("dot"))
    scored = dots.join(norm(a, "qid", "nq"), "qid").join(norm(b, "cid", "nc"), "cid")
    return _top(scored.select("qid", "cid", F.round(F.col("dot") / (F.col("nq") * F.col("nc")), 6).alias("score")).filter(F.col("score") > least), top)


def tfidf_matches(found: DataFrame, at: float = 0.85) -> DataFrame:
    """Of ``tfidf_top`` what is near enough to be taken for a match."""
    return found.filter(F.col("score") >= at).select("qid", "cid", "score")
