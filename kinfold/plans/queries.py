"""The registry: every operator as a query on the test tables, with its DuckDB statement where SQL has one."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocking as B
from ..operators import features as X
from ..operators import retrieval as R
from ..operators import selection as S
from ..session import collect_garbage, discard, table, written
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, oracle: str | None = None, low: bool = False) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle if oracle.startswith("WITH ") else fx.sql(oracle, low)
        return f

    return add


_KEPT: dict[tuple, object] = {}


def _release(spark: SparkSession, value: object) -> None:
    for x in value if isinstance(value, tuple) else (value,):
        if isinstance(x, (DataFrame, B.Names)):
            x.unpersist()
            for path in [*getattr(x, "_kinfold_paths", ()), *filter(None, [getattr(x, "_kinfold_path", None)])]:
                discard(spark, path)


def _table(df: DataFrame, label: str) -> DataFrame:
    """A table in the shared folder: plans that read it several times don't repeat what made it."""
    out, path = written(df, label)
    out._kinfold_path = path
    return out


def _folder(spark: SparkSession, d: str) -> tuple:
    """The session, the folder, and when its documents were last written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.sparkContext.applicationId, d, store.getFileStatus(at).getModificationTime() if store.exists(at) else None


def _kept(f):
    """What many queries share (the index, the union, the joined candidates) is built and cached once, as it is for the shards of a run.
    Only one folder's tables are kept: those of another, or of a folder that has been written anew, let go of them."""

    @wraps(f)
    def call(spark: SparkSession, d: str, *options):
        folder = _folder(spark, d)
        if _KEPT and next(iter(_KEPT))[0] != folder:
            if next(iter(_KEPT))[0][0] == folder[0]:
                for value in _KEPT.values():
                    _release(spark, value)
            _KEPT.clear()
        key = (folder, f.__name__, *options)
        if key not in _KEPT:
            made = f(spark, d, *options)
            _KEPT[key] = made
        return _KEPT[key]

    return call


@_kept
def _records(spark: SparkSession, d: str) -> DataFrame:
    return _table(fx.records(spark, d), "records")  # a union reads its records some thirty times


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rec = _records(spark, d)
    return rec.filter("side = 0"), rec.filter("side <> 0")


def _new_index(spark: SparkSession, d: str, low: bool = False) -> tuple[DataFrame, B.Index]:
    s1, pool = _split(spark, d)
    return s1, B.Index(pool, B.Knobs.low() if low else B.Knobs()).persist()


_index = _kept(_new_index)


@_kept
def _union(spark: SparkSession, d: str, low: bool = False, order: str = "fair") -> DataFrame:
    shared = any(k[1] == _index.__name__ and k[2:] == (low,) for k in _KEPT)
    s1, index = _index(spark, d, low) if shared else _new_index(spark, d, low)
    paths = []

    def keep(rows: DataFrame) -> DataFrame:
        out, path = written(rows, "scheme")
        paths.append(path)
        collect_garbage(spark)
        return out

    rows = B.found(s1, index, keep=keep)
    weights = keep(B.name_weight(s1, index))
    pairs = B.united(rows, weights, order)
    if not shared:  # no other query has plans of it
        index.discard()
    del s1, index, rows, weights
    _let_go(spark, _index)
    made = _table(pairs, "union")
    for path in paths:
        discard(spark, path)
    del pairs
    collect_garbage(spark)
    return made


def _let_go(spark: SparkSession, *makers) -> None:
    """Whatever the makers have kept goes, with its caches and shuffle files: they are several times the input and no plan that follows reads them. Who asks again
    gets them made again; plans of them that are still to run make what they read."""
    for key in [k for k in _KEPT if k[1] in {f.__name__ for f in makers}]:
        _release(spark, _KEPT.pop(key))
    collect_garbage(spark)


@_kept
def _names(spark: SparkSession, d: str) -> tuple[DataFrame, B.Names]:
    s1, pool = _split(spark, d)
    return s1, B.Names(pool)


def _best(spark: SparkSession, d: str) -> DataFrame:
    """The best candidates as the union has them, for queries that read no field of a record: each record is there once, so a join with it changes no row."""
    return B.top_k(_union(spark, d, False, "fair"), B.Knobs().top_k)


def _base(spark: SparkSession, d: str, words: bool = False) -> tuple[DataFrame, DataFrame, B.Names]:
    """The best candidates with their records' fields, as a plan: each query joins the fields that it reads and no others. A table of it would hold both whole
    addresses once a pair, some hundred times the documents. ``words``: with the weighed words of both names."""
    best = _best(spark, d)
    s1, index = _names(spark, d)
    return X.base(best, s1, index.pool, index if words else None), s1, index


PARTS = 8  # of the reference records, whose pairs get their addresses part by part


def _by_parts(spark: SparkSession, d: str, made: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """What ``made`` makes of the best candidates with their records' fields, as a table. A pair carries a reference record's whole address through a shuffle, which for all pairs at once
    is some ten times the documents; so an eighth of the reference records goes at a time, and its shuffle files go before the next."""
    best = _best(spark, d)
    s1, index = _names(spark, d)
    part = lambda key, k: F.pmod(F.xxhash64(key), F.lit(PARTS)) == k
    rows, paths = None, []
    for k in range(PARTS):
        out, path = written(made(X.base(best.filter(part("s1_id", k)), s1.filter(part("entity_id", k)), index.pool)), label)
        paths.append(path)
        rows = out if rows is None else rows.unionByName(out)
        collect_garbage(spark)
    rows._kinfold_paths = paths
    return rows


@_kept
def _truth(spark: SparkSession, d: str) -> DataFrame:
    return fx.truth(*_split(spark, d)).persist()


# Normalized records and key statistics
@register("norm_tokens", f"SELECT lang AS country, token, count(*) AS n FROM (SELECT lang, unnest(toks) AS token FROM toks) WHERE token NOT IN ({fx._NOISE}) GROUP BY ALL")
def norm_tokens(spark, d):
    words = T.without(T.words(F.col("text")))
    return table(spark, d, "documents").select(F.col("lang").alias("country"), F.explode(words).alias("token")).groupBy("country", "token").agg(F.count(F.lit(1)).alias("n"))


@register("norm_name_key", "SELECT entity_id, country, name_key, name_text, len(name_tokens) AS n_core FROM rec")
def norm_name_key(spark, d):
    return _records(spark, d).select("entity_id", "country", "name_key", "name_text", F.size("name_tokens").alias("n_core"))


@register("norm_postcode", "SELECT entity_id, postcode, array_to_string(addr_tokens, ' ') AS addr_text, addr_nums[1] AS addr_num, addr_empty FROM rec")
def norm_postcode(spark, d):
    return _records(spark, d).select("entity_id", "postcode", F.array_join("addr_tokens", " ").alias("addr_text"), F.col("addr_nums")[0].alias("addr_num"), "addr_empty")


for _n, _t in (("token", "tok"), ("skel", "skel"), ("addr", "atok"), ("pair", "pair"), ("g", "g"), ("h", "h")):
    register(f"{_n}_df", f"SELECT country, key, df, idf FROM {_t}_df")(lambda spark, d, t=_t: getattr(_index(spark, d, False)[1], f"{t}_stats"))


# Query keys and the nine schemes, with the usual ceilings and with ceilings that bind
for _low, _tail in ((False, ""), (True, "_low_ceiling")):
    register(f"rare_tokens{_tail}", "SELECT entity_id, key, df, idf FROM q_b", _low)(lambda spark, d, low=_low: (lambda s1, i: i.queries(s1)["b"].select("entity_id", "key", "df", "idf"))(*_index(spark, d, low)))
    for _s in B.SCHEMES:
        if _low and _s in ("a", "a2", "d"):
            continue  # no ceilings there
        register(f"scheme_{_s}{_tail}", f"SELECT s1_id, cand_id, idf_score, shared, rk FROM p_{_s}", _low)(
            lambda spark, d, s=_s, low=_low: (lambda s1, i: i.scheme(s, s1).select("s1_id", "cand_id", "idf_score", "shared", "rk"))(*_index(spark, d, low)))

_ESTIMATES = " UNION ALL ".join(
    [f"SELECT '{s}' AS scheme, coalesce(sum(df), 0)::BIGINT AS pairs FROM q_{s}" for s in "bcefgh"]
    + [
        "SELECT 'a', count(*) FROM s1 a JOIN pool b USING (country, name_key) WHERE name_key <> ''",
        f"SELECT 'a2', count(*) FROM (SELECT country, {fx._SQUASH} AS q FROM s1) a JOIN (SELECT country, {fx._SQUASH} AS q FROM pool) b USING (country, q) WHERE length(q) >= 4",
        "SELECT 'd', count(*) FROM (SELECT country, postcode, unnest(name_tokens) AS key FROM s1 WHERE postcode <> '') a JOIN (SELECT country, postcode, unnest(name_tokens) AS key FROM pool WHERE postcode <> '') b USING (country, postcode, key)",
    ]
)


@register("pair_estimate", _ESTIMATES)
def pair_estimate(spark, d):
    s1, index = _index(spark, d, False)
    return index.estimates(s1)


_FLAGS = ", ".join(f"by_{s}" for s in B.SCHEMES)
for _o in ("fair", "containment"):
    register(f"union_{_o}", f"SELECT s1_id, cand_id, {_FLAGS}, idf_score, shared, containment, rnk FROM u_{_o}")(lambda spark, d, o=_o: _union(spark, d, False, o))
register("union_fair_low_ceiling", f"SELECT s1_id, cand_id, {_FLAGS}, idf_score, shared, containment, rnk FROM u_fair", True)(lambda spark, d: _union(spark, d, True, "fair"))
register("topk", "SELECT s1_id, cand_id, rnk FROM u_fair WHERE rnk <= 10")(lambda spark, d: B.top_k(_union(spark, d, False, "fair"), 10).select("s1_id", "cand_id", "rnk"))
register("union_a_to_f", f"SELECT s1_id, cand_id, {_FLAGS}, idf_score, shared, containment, rnk FROM u_af WHERE rnk <= 30")(lambda spark, d: (lambda s1, i: B.top_k(B.union(s1, i, "containment", ("a", "a2", "b", "c", "d", "e", "f")), 30))(*_index(spark, d, False)))


# Diagnostics
_KS = (10, 30, 50, 100, 200, 500)


@register("recall_at_k", "SELECT count(*) AS n_true, count(rnk) AS generated, " + ", ".join(f"coalesce(sum((rnk <= {k})::INT), 0)::BIGINT AS found_{k}" for k in _KS) + " FROM gt LEFT JOIN u_fair USING (s1_id, cand_id)")
def recall_at_k(spark, d):
    return B.recall_at(_union(spark, d, False, "fair"), _truth(spark, d), _KS)


@register("blocking_report", """SELECT round(avg(n), 6) AS mean_candidates, round(sum(h)::DOUBLE / sum(m), 6) AS micro_recall, round(avg(CASE WHEN m > 0 THEN h::DOUBLE / m END), 6) AS macro_recall,
  sum((m > 0 AND h = 0)::INT)::BIGINT AS nothing_found, sum((m > 0 AND h = m)::INT)::BIGINT AS all_found, round(avg(CASE WHEN m = 0 THEN 1.0 WHEN h = 0 THEN 0.0 ELSE 1.25 * h / (h + 0.25 * m) END), 6) AS ceiling_f05
  FROM (SELECT s.entity_id, (SELECT count(*) FROM u_fair u WHERE u.s1_id = s.entity_id AND rnk <= 100) AS n, (SELECT count(*) FROM gt WHERE gt.s1_id = s.entity_id) AS m,
    (SELECT count(*) FROM gt JOIN u_fair u USING (s1_id, cand_id) WHERE gt.s1_id = s.entity_id AND rnk <= 100) AS h FROM s1 s)""")
def blocking_report(spark, d):
    s1, _ = _split(spark, d)
    return B.report(B.top_k(_union(spark, d, False, "fair"), 100), _truth(spark, d), s1)


_MISS = "FROM gt JOIN s1 s ON s.entity_id = gt.s1_id JOIN pool c ON c.entity_id = gt.cand_id WHERE NOT EXISTS (SELECT 1 FROM p_g p WHERE p.s1_id = gt.s1_id AND p.cand_id = gt.cand_id)"


@register("misses", f"SELECT gt.s1_id, gt.cand_id, array_to_string(list_sort(list_intersect(s.name_tokens, c.name_tokens)), ' ') AS shared_tokens, list_has_any(s.addr_nums, c.addr_nums)::INT AS address_helps {_MISS}")
def misses(spark, d):
    s1, index = _index(spark, d, False)
    return B.misses(index.scheme("g", s1), _truth(spark, d), s1, index.pool)


# Pair features
_J = fx._jac


@register("feat_name_sets", f"""SELECT s1_id, cand_id, {_J('s_tok', 'c_tok')} AS n_jacc, CASE WHEN greatest(length(s_name), length(c_name)) = 0 THEN 0.0 ELSE least(length(s_name), length(c_name))::DOUBLE / greatest(length(s_name), length(c_name)) END AS n_len_ratio,
  abs(len(s_tok) - len(c_tok))::INT AS n_tok_diff, (s_key = c_key AND s_key <> '')::INT AS n_exact_key, list_has_any(s_suf, c_suf)::INT AS n_suffix_agree, (len(s_suf) > 0 AND len(c_suf) > 0 AND NOT list_has_any(s_suf, c_suf))::INT AS n_suffix_conflict FROM base""")
def feat_name_sets(spark, d):
    return X.name_sets(_base(spark, d)[0])


@register("feat_addr", f"""SELECT s1_id, cand_id, {_J('s_atok', 'c_atok')} AS a_jacc, (s_post <> '' AND s_post = c_post)::INT AS a_post_match, (s_post <> '' AND c_post <> '')::INT AS a_post_both, {_J('s_num', 'c_num')} AS a_num_overlap,
  (len(s_num) > 0 AND len(c_num) > 0)::INT AS a_num_both, (s_empty OR c_empty)::INT AS a_empty_either FROM base""")
@_kept
def feat_addr(spark, d):
    return _by_parts(spark, d, X.address, "addr")


@register("feat_source", "SELECT s1_id, cand_id, CASE WHEN starts_with(cand_id, 'S2-') THEN 2 ELSE 3 END AS c_source, (s_country = c_country)::INT AS c_same_country FROM base")
def feat_source(spark, d):
    return X.sources(_base(spark, d)[0])


_SUMS = "(SELECT {0}, sum(idf)::DOUBLE AS {1} FROM (SELECT {2} {0}, s_country AS country, unnest({3}) AS key FROM {4}) JOIN tok_df USING (country, key) GROUP BY {0})"


@register("feat_idf_cover", "SELECT s1_id, cand_id, coalesce(coalesce(w, 0) / nullif(ws, 0), 0) AS n_idf_cover_s1, coalesce(coalesce(w, 0) / nullif(wc, 0), 0) AS n_idf_cover_c FROM base LEFT JOIN "
    + _SUMS.format("s1_id, cand_id", "w", "", "list_intersect(s_tok, c_tok)", "base") + " USING (s1_id, cand_id) LEFT JOIN " + _SUMS.format("s1_id", "ws", "", "s_tok", "(SELECT DISTINCT s1_id, s_country, s_tok FROM base)")
    + " USING (s1_id) LEFT JOIN " + _SUMS.format("cand_id", "wc", "", "c_tok", "(SELECT DISTINCT cand_id, s_country, c_tok FROM base)") + " USING (cand_id)")
def feat_idf_cover(spark, d):
    return X.idf_cover(_base(spark, d, True)[0])


@register("feat_skeleton", f"SELECT s1_id, cand_id, {_J('s_sk', 'c_sk')} AS n_skel_jacc, coalesce(array_to_string(s_sk, ' '), '') AS s_skel, coalesce(array_to_string(c_sk, ' '), '') AS c_skel FROM base LEFT JOIN s_sk USING (s1_id) LEFT JOIN c_sk USING (cand_id)")
def feat_skeleton(spark, d):
    return X.skeletons(_base(spark, d)[0])


@register("feat_leftover", "SELECT s1_id, cand_id, coalesce(e.cnt, 0) AS n_extra_cnt, coalesce(e.heaviest, 0) AS n_extra_max_idf, coalesce(m.cnt, 0) AS n_missing_cnt, coalesce(m.heaviest, 0) AS n_missing_max_idf"
    " FROM base LEFT JOIN extra e USING (s1_id, cand_id) LEFT JOIN missing m USING (s1_id, cand_id)")
def feat_leftover(spark, d):
    return X.leftovers(_base(spark, d, True)[0])


@register("feat_rival", f"""SELECT b.s1_id, b.cand_id, greatest(coalesce(ks.n, 0), 1) AS x_s1_name_dup, coalesce(kc.n, 0) AS x_c_name_s1cnt, r.j AS x_rival_addr, r.j - {_J('s_atok', 'c_atok')} AS x_rival_addr_adv, r.num AS x_rival_num
  FROM base b LEFT JOIN names ks ON ks.country = s_country AND ks.name_key = s_key LEFT JOIN names kc ON kc.country = c_country AND kc.name_key = c_key
  LEFT JOIN (SELECT s1_id, cand_id, max({_J('list_distinct(o.addr_tokens)', 'c_atok')}) AS j, max(list_has_any(o.addr_nums, c_num)::INT) AS num FROM base JOIN s1 o ON o.country = c_country AND o.name_key = c_key AND o.entity_id <> s1_id
    WHERE c_key <> '' GROUP BY s1_id, cand_id) r USING (s1_id, cand_id)""")
def feat_rival(spark, d):
    b, s1, index = _base(spark, d)
    return X.rivals(b, s1, index.pool)


@register("feat_group", """SELECT s1_id, cand_id, n AS g_n_cands, rk::DOUBLE / n AS g_rank_frac, CASE WHEN mx > 0 THEN score::DOUBLE / mx ELSE 0.0 END AS g_score_ratio, score - mx AS g_score_margin, (rk = 1)::INT AS g_is_top FROM (
  SELECT s1_id, cand_id, idf_score AS score, count(*) OVER (PARTITION BY s1_id) AS n, row_number() OVER (PARTITION BY s1_id ORDER BY idf_score DESC, cand_id) AS rk, max(idf_score) OVER (PARTITION BY s1_id) AS mx FROM base)""")
def feat_group(spark, d):
    return X.group(_base(spark, d)[0], "idf_score")


# Selection, on made-up probabilities
@_kept
def _probs(spark, d):
    return fx.probabilities(_union(spark, d, False, "fair")).persist()


@register("select_approx", "SELECT s1_id, cand_id, p FROM approx")
def select_approx(spark, d):
    return S.select_approximate(_probs(spark, d))


@register("select_threshold", "SELECT s1_id, cand_id, p FROM probs WHERE p >= 0.9")
def select_threshold(spark, d):
    return S.select_threshold(_probs(spark, d), 0.9)


@register("select_exact", "SELECT s1_id, cand_id, p FROM kept JOIN cuts USING (s1_id) WHERE k <= cut")
def select_exact(spark, d):
    return S.select_exact(_probs(spark, d))


@register("exclusivity_round1", "SELECT s1_id, cand_id, p FROM approx ANTI JOIN lost USING (s1_id, cand_id)")
def exclusivity_round1(spark, d):
    chosen = S.select_approximate(_probs(spark, d))
    return chosen.join(S.losers(chosen), ["s1_id", "cand_id"], "left_anti").select("s1_id", "cand_id", "p")


@register("exclusivity_fix")
def exclusivity_fix(spark, d):
    return S.repair(_probs(spark, d), S.select_approximate)


@register("list_context", """SELECT s1_id, cand_id, p, k AS rank, n, round(e_m, 6) AS e_m, p_max, coalesce(p2, 0) AS p_2nd, round(p / greatest(p_max, 1e-9), 6) AS p_rel, round(p_max - p, 6) AS gap_top, round(coalesce(prev - p, 0), 6) AS gap_prev, round(coalesce(p - nxt, p), 6) AS gap_next,
  round(cum, 6) AS cum_p, round(e_m - p, 6) AS rest_p, over_half AS n_over_half, round(ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))), 6) AS logit_p FROM (SELECT *, count(*) OVER w AS n, max(p) OVER w AS p_max, max(CASE WHEN k = 2 THEN p END) OVER w AS p2,
  lag(p) OVER o AS prev, lead(p) OVER o AS nxt, sum(p) OVER (PARTITION BY s1_id ORDER BY k) AS cum, (sum((p > 0.5)::INT) OVER w)::BIGINT AS over_half FROM kept JOIN mass USING (s1_id) WINDOW w AS (PARTITION BY s1_id), o AS (PARTITION BY s1_id ORDER BY k))""")
def list_context(spark, d):
    probs = _probs(spark, d)
    out = X.list_context(probs, probs.groupBy("s1_id").agg(F.sum("p").alias("e_m")))
    return out.select(*[F.round(c, 6).alias(c) if c in ("e_m", "p_rel", "gap_top", "gap_prev", "gap_next", "cum_p", "rest_p", "logit_p") else c for c in out.columns])


@register("f05_macro", "SELECT round(avg(f05), 6) AS f05, sum(k)::BIGINT AS n_chosen, sum(m)::BIGINT AS n_true, sum(h)::BIGINT AS n_hit FROM scored")
def f05_macro(spark, d):
    s1, _ = _split(spark, d)
    each = S.f05(S.select_approximate(_probs(spark, d)), _truth(spark, d), s1.select(F.col("entity_id").alias("s1_id")))
    return each.agg(F.round(F.avg("f05"), 6).alias("f05"), F.sum("k").alias("n_chosen"), F.sum("m").alias("n_true"), F.sum("h").alias("n_hit"))


@register("error_taxonomy", """SELECT category, country, count(*) AS n, round(sum(1 - f05), 6) AS lost FROM (SELECT *, CASE WHEN f05 = 1 THEN 'right' WHEN m = 0 AND k > 0 THEN 'false match' WHEN m > 0 AND k = 0 THEN 'missed all' WHEN h = 0 THEN 'all wrong' WHEN h < k THEN 'some wrong' ELSE 'too few' END AS category FROM scored) GROUP BY ALL""")
def error_taxonomy(spark, d):
    s1, _ = _split(spark, d)
    ids = s1.select(F.col("entity_id").alias("s1_id"), "country")
    return S.error_taxonomy(S.f05(S.select_approximate(_probs(spark, d)), _truth(spark, d), ids))


# Retrieval
@register("knn_topk", "SELECT qid, cid, score, rank FROM near")
def knn_topk(spark, d):
    return R.knn(*fx.vectors(spark, d), 10)


def _ann(spark, d):
    return R.knn(*fx.vectors(spark, d), 10).select(F.col("qid").alias("s1_id"), F.col("cid").alias("cand_id"), F.col("score").alias("ann_score"), F.col("rank").alias("ann_rank"))


def _vector_pairs(spark, d):
    return fx.vector_blocks(*fx.vectors(spark, d))


_VP = "vblock"
_OWN = f"(SELECT qid AS s1_id, cid AS cand_id, score AS ann_score, rank AS ann_rank, max(score) OVER (PARTITION BY qid) AS ann_top FROM near WHERE qid IN (SELECT s1_id FROM {_VP}))"


@register("with_ann_known", f"SELECT p.s1_id, p.cand_id, p.p, a.ann_score, a.ann_rank, 1 AS in_blocked, t.ann_top, t.ann_top - a.ann_score AS ann_gap FROM {_VP} p LEFT JOIN {_OWN} a USING (s1_id, cand_id) LEFT JOIN (SELECT DISTINCT s1_id, ann_top FROM {_OWN}) t ON t.s1_id = p.s1_id")
def with_ann_known(spark, d):
    pairs = _vector_pairs(spark, d)
    return R.with_ann(pairs, _ann(spark, d), pairs, 5)["known"]


@register("with_ann_extra", f"SELECT s1_id, cand_id, 0.0::DOUBLE AS p, ann_score, ann_rank, 0 AS in_blocked, ann_top, ann_top - ann_score AS ann_gap FROM {_OWN} a WHERE ann_rank <= 5 AND NOT EXISTS (SELECT 1 FROM {_VP} p WHERE p.s1_id = a.s1_id AND p.cand_id = a.cand_id)")
def with_ann_extra(spark, d):
    pairs = _vector_pairs(spark, d)
    return R.with_ann(pairs, _ann(spark, d), pairs, 5)["extra"]


@register("gate", f"SELECT count(*) AS n_true, sum(f)::BIGINT AS blocked, sum(a)::BIGINT AS retrieved, sum(f * a)::BIGINT AS both, sum(greatest(f, a))::BIGINT AS either FROM (SELECT (p.s1_id IS NOT NULL)::INT AS f, (a.s1_id IS NOT NULL)::INT AS a FROM (SELECT qid AS s1_id, cid AS cand_id FROM near) t LEFT JOIN {_VP} p USING (s1_id, cand_id) LEFT JOIN (SELECT qid AS s1_id, cid AS cand_id FROM near WHERE rank <= 5) a USING (s1_id, cand_id))")
def gate(spark, d):
    ann = _ann(spark, d)
    return R.gate(ann.select("s1_id", "cand_id"), _vector_pairs(spark, d), ann, 5)


@register("tfidf_topn", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rank FROM (
  SELECT a.id AS qid, b.id AS cid, round(sum(a.w::HUGEINT * b.w)::DOUBLE / (max(a.norm) * max(b.norm)), 6) AS score FROM uq a JOIN uc b USING (g) GROUP BY ALL) WHERE score > 0.05) WHERE rank <= 25""")
def tfidf_topn(spark, d):
    return _tfidf(spark, d)


def _tfidf(spark, d, **options):
    s1, pool = _split(spark, d)
    of = lambda df: df.select(F.col("entity_id").alias("id"), F.col("name_tokens").alias("tokens"))
    return R.tfidf_top(of(s1), of(pool), pool.count(), **options)


# Sinks, splits, exploration
@register("match_tsv", "SELECT s.entity_id AS source1_entity_id, coalesce(string_agg(cand_id, ',' ORDER BY cand_id), '') AS matched_entity_ids FROM s1 s LEFT JOIN approx ON approx.s1_id = s.entity_id GROUP BY 1")
def match_tsv(spark, d):
    from ..sources.io import match_lines

    s1, _ = _split(spark, d)
    return match_lines(s1.select("entity_id"), S.select_approximate(_probs(spark, d)), "matched_entity_ids")


@register("candidate_tsv", "SELECT s.entity_id AS source1_entity_id, coalesce(string_agg(cand_id, ',' ORDER BY cand_id), '') AS candidate_entity_ids FROM s1 s LEFT JOIN (SELECT * FROM u_fair WHERE rnk <= 100) u ON u.s1_id = s.entity_id GROUP BY 1")
def candidate_tsv(spark, d):
    from ..sources.io import match_lines

    s1, index = _index(spark, d, False)
    return match_lines(s1.select("entity_id"), B.top_k(_union(spark, d, False, "fair"), 100), "candidate_entity_ids")


_B = "('0x' || substr(md5({0}), 1, 8))::BIGINT"


@register("fold_split", f"SELECT entity_id, CASE WHEN {_B.format('entity_id')} % 100 < 70 THEN 0 WHEN {_B.format('entity_id')} % 100 < 85 THEN 1 ELSE 2 END AS fold, ({_B.format("'cv' || entity_id")} % 5)::INT AS cv FROM s1")
def fold_split(spark, d):
    s1, _ = _split(spark, d)
    b = T.bucket(F.col("entity_id"), 100)
    return s1.select("entity_id", F.when(b < 70, 0).when(b < 85, 1).otherwise(2).alias("fold"), T.bucket(F.col("entity_id"), 5, "cv").alias("cv"))


@register("sample_per_mille", f"SELECT entity_id FROM s1 WHERE {_B.format('entity_id')} % 1000 < 50")
def sample_per_mille(spark, d):
    s1, _ = _split(spark, d)
    return s1.filter(T.bucket(F.col("entity_id"), 1000) < 50).select("entity_id")


@register("match_histogram", "SELECT n, count(*) AS records FROM (SELECT s.entity_id, count(cand_id) AS n FROM s1 s LEFT JOIN gt ON gt.s1_id = s.entity_id GROUP BY 1) GROUP BY n")
def match_histogram(spark, d):
    s1, _ = _split(spark, d)
    n = s1.select(F.col("entity_id").alias("s1_id")).join(_truth(spark, d), "s1_id", "left").groupBy("s1_id").agg(F.count("cand_id").alias("n"))
    return n.groupBy("n").agg(F.count(F.lit(1)).alias("records"))


@register("null_summary", "SELECT count(*) AS n_rows, " + ", ".join(f"count(*) - count({c}) AS {c}" for c in ("doc_id", "text", "lang", "source")) + " FROM documents")
def null_summary(spark, d):
    docs = table(spark, d, "documents")
    return docs.agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in ("doc_id", "text", "lang", "source")])


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@register("word_ngrams", f"SELECT gram, count(*) AS n FROM (SELECT unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS gram FROM (SELECT [t FOR t IN toks IF t NOT IN ({_STOP})] AS w FROM toks)) GROUP BY gram")
def word_ngrams(spark, d):
    words = table(spark, d, "documents").select(T.words(F.col("text")).alias("t"))
    return words.select(F.explode(T.word_ngrams(F.col("t"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@register("owner_conflicts", "SELECT count(*) AS records, coalesce(sum(n - 1), 0)::BIGINT AS surplus FROM (SELECT cand_id, count(*) AS n FROM approx GROUP BY 1 HAVING count(*) > 1)")
def owner_conflicts(spark, d):
    n = S.select_approximate(_probs(spark, d)).groupBy("cand_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return n.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


# String scores over candidates, each in its pair's row
def _scored(spark, d, name, out):
    from ..functions.similarity import score

    return _base(spark, d)[0].select("s1_id", "cand_id", score(name, F.col("s_name"), F.col("c_name")).alias(out))


@register("feat_jaro", "SELECT s1_id, cand_id, round(CASE WHEN s_name = '' OR c_name = '' THEN 0.0 ELSE jaro_winkler_similarity(s_name, c_name) END, 6) AS n_jaro FROM base")
def feat_jaro(spark, d):
    return _scored(spark, d, "jaro_winkler", "n_jaro").withColumn("n_jaro", F.round("n_jaro", 6))


for _q, _f in (("ratio", "ratio"), ("prefix", "prefix_ratio"), ("token_sort", "token_sort_ratio"), ("token_set", "token_set_ratio"), ("partial", "partial_ratio")):
    register(f"feat_{_q}")(lambda spark, d, q=_q, f=_f: _scored(spark, d, f, f"n_{q}"))
