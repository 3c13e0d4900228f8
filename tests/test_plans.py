import random

import __spark_entry__ as entry
from kinfold.functions import similarity as sim
from kinfold.session import _written

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_features_join_what_they_read(spark):
    """No table of candidates with both whole addresses, and no column of them in queries that don't read them."""
    for name in ("feat_source", "feat_idf_cover", "feat_skeleton", "feat_name_sets", "feat_group", "feat_jaro"):
        assert "_atok" not in plan_of(entry.queries()[name](spark, SF)), name
    assert not [p for p in _written if "kinfold-base-" in p]


def test_matrix_rows_scores_no_strings(spark):
    """Who counts the matrix doesn't make its string scores; whoever reads it does."""
    assert "EvalPython" not in plan_of(entry.queries()["matrix_rows"](spark, SF))
    assert "EvalPython" in plan_of(entry.queries()["feature_matrix"](spark, SF))


def test_token_set_is_the_best_of_three():
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(12)]
    for _ in range(500):
        a, b = ({rng.choice(words) for _ in range(rng.randint(1, 5))} for _ in range(2))
        both = " ".join(sorted(a & b))
        one, two = (" ".join(filter(None, (both, " ".join(sorted(s))))) for s in (a - b, b - a))
        want = 1.0 if both and (a <= b or b <= a) else max(sim.ratio(one, two), sim.ratio(both, one), sim.ratio(both, two))
        assert sim.token_set_ratio(" ".join(a), " ".join(b)) == want


def test_rarest_address_words_without_the_common_ones(spark):
    """Words above the ceiling that tasks know aren't shuffled, and each record's rarest are those of all its words, repeats included."""
    from kinfold.operators import blocking as B
    from kinfold.plans import fixtures as fx
    from pyspark.sql import functions as F

    s1, pool = fx.split(spark, SF)
    index = B.Index(pool, B.Knobs(addr_max_df=5))
    assert index._common and index.awords.agg(F.sum("n")).first()[0] < index.atok.count() / 2
    for records in (s1, pool):
        for n, least in ((4, 1), (4, 3), (3, 3)):
            plain = B.rarest(B.tokens(records, "addr_tokens").filter(F.length("key") >= least), index.atok_stats, n)
            assert sorted(map(tuple, index.rare_address(records, n, least).collect())) == sorted(map(tuple, plain.select("entity_id", "country", "key", "df", "idf").collect()))
    index.unpersist()


def test_cells_get_words_and_not_their_grams(spark):
    """What is dealt to every cell is a name's words; of more grams than tasks may know the records bring their own, with equal results."""
    from kinfold.operators import retrieval as R

    rng = random.Random(5)
    rows = [(i, ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(0, 4))]) for i in range(80)]
    of = lambda rows: spark.createDataFrame(rows, "id long, tokens array<string>")
    q, c = of([*rows[:30], (3, ["abca"])]), of([*rows[30:], (40, ["abcab", "dd"])])
    found = lambda df: sorted((r.qid, r["rank"], r.cid, r.score) for r in df.collect())
    one = R.tfidf_top(q, c, 50, top=6, block=7, cell=11)
    assert "xxhash64(g" not in plan_of(one)
    assert found(one) == found(R.tfidf_top(q, c, 50, top=6, block=7 * 8, cell=11 * 8, known=10)) == found(R.tfidf_join(q, c, 50, top=6))


def test_features_run_without_the_index(spark):
    """The union lets go of the index, whose caches and shuffles are several times the input; plans that hold it still run, and who asks again gets it."""
    from kinfold.plans import queries as Q

    sf = "/root/testdata/sf0.001"
    Q._records(spark, sf)  # lets go of other folders
    for key in list(Q._KEPT):
        if key[1] != "_records":
            Q._release(spark, Q._KEPT.pop(key))
    index = Q._index(spark, sf, False)[1]
    want = sorted(index.tok_stats.collect())
    entry.queries()["feat_leftover"](spark, sf).count()
    assert "_index" not in {key[1] for key in Q._KEPT}
    assert not index.tok.is_cached and not [p for p in _written if "kinfold-scheme-" in p]
    assert sorted(index.tok_stats.collect()) == want == sorted(Q._index(spark, sf, False)[1].tok_stats.collect())


def test_matrix_rows_reads_no_addresses(spark):
    sf = "/root/testdata/sf0.001"
    rows = entry.queries()["matrix_rows"](spark, sf)
    assert "_atok" not in plan_of(rows) and "namesakes" not in plan_of(rows)
    whole = entry.queries()["feature_matrix"](spark, sf).select("s1_id", "b_by_a", "b_shared").collect()
    assert tuple(rows.first()) == (len(whole), len({r.s1_id for r in whole}), sum(r.b_by_a for r in whole), sum(r.b_shared for r in whole))


def test_address_words_are_taken_apart_once_a_record(spark):
    from kinfold.operators import blocking as B

    rows = [(f"S2-{i}", "en", ["x"], [f"w{i % 5}", "road"], [], "") for i in range(12)]
    pool = spark.createDataFrame(rows, "entity_id string, country string, name_tokens array<string>, addr_tokens array<string>, addr_nums array<string>, postcode string")
    index = B.Index(pool, B.Knobs.low())
    words = index.address_words(pool)
    assert "MapInArrow" not in words._jdf.queryExecution().toString()  # the rows with a rarity and those without read one table
    found = {(r["entity_id"], r["key"]): (r["n"], r["df"]) for r in words.collect()}
    assert found == {(f"S2-{i}", k): (1, df) for i in range(12) for k, df in ((f"w{i % 5}", 3 if i % 5 < 2 else 2), ("road", 12))}
    index.unpersist()


def test_skeletons_are_made_once_a_record(spark):
    """Pairs carry two texts: no word is weighed, exploded or gathered for them."""
    plan = plan_of(entry.queries()["feat_skeleton"](spark, SF))
    assert "Generate" not in plan and "Aggregate" not in plan and "collect_list" not in plan


def test_origin_joins_no_records(spark):
    """What the union says of a pair is read where it lies."""
    assert "Join" not in plan_of(entry.queries()["feat_origin"](spark, SF)) and "Join" not in plan_of(entry.queries()["matrix_rows"](spark, SF))


def test_equal_pairs_are_compared_once_a_batch(spark, monkeypatch):
    import pandas as pd

    asked = []
    monkeypatch.setitem(sim.SCORES, "partial_ratio", lambda a, b: (asked.append((a, b)), sim.partial_ratio(a, b))[1])
    made = []
    monkeypatch.setattr(sim.F, "pandas_udf", lambda run, kind: lambda *columns: made.append(run))
    sim.scores({"n": "partial_ratio"}, None, None)
    got = made[0](pd.Series(["abc", None, "abc", "abd"] * 50), pd.Series(["xbc", "", "xbc", None] * 50))
    assert len(asked) == 3 and list(got["n"]) == [sim.partial_ratio("abc", "xbc"), 0.0, sim.partial_ratio("abc", "xbc"), 0.0] * 50
    assert str(got["n"].dtype) == "float64" and len(made[0](pd.Series([], dtype=str), pd.Series([], dtype=str))) == 0


def test_scorer_is_fitted_on_all_records(spark, monkeypatch):
    """Trees and calibration see every pair of their folds, of however many records."""
    from kinfold.operators import features as X
    from kinfold.operators import learn as L
    from kinfold.plans import more as M
    from pyspark.sql import functions as F

    value = lambda i, c: F.when(F.col("id") % 5 > 0, F.col("id") % (i + 2)).otherwise(None if c in X.NULLABLE else 0).cast("float").alias(c)
    pairs = spark.range(1600).select(F.concat(F.lit("s"), F.floor(F.col("id") / 2)).alias("s1_id"), F.concat(F.lit("c"), "id").alias("cand_id"), *[value(i, c) for i, c in enumerate(X.FEATURES)])
    given = {}
    monkeypatch.setattr(M, "_matrix", lambda spark, d: pairs)
    monkeypatch.setattr(M, "_truth", lambda spark, d: pairs.filter("n_jacc = 1").select("s1_id", "cand_id"))
    monkeypatch.setattr(L, "fit_trees", lambda rows, names, **kw: given.update(rows=rows, names=names))
    monkeypatch.setattr(L, "predicted", lambda model, rows: rows)
    monkeypatch.setattr(L, "calibrate", lambda scored: given.update(calibrated=scored))
    rows = M._fitted(spark, "/root/testdata/no-such")[2]
    assert rows.count() == given["rows"].count() == 1600 and given["rows"].select("s1_id").distinct().count() == 800
    assert given["calibrated"].count() == rows.filter("fold = 1").count() > 0
    assert set(X.FEATURES) | {f"{c}__null" for c in X.NULLABLE} <= set(given["names"])
    assert rows.filter(" OR ".join(f"{n} IS NULL" for n in given["names"])).count() == 0 < rows.filter("x_rival_num__null = 1").count()


def test_names_meet_the_cells_once_and_only_as_far_as_they_count(spark):
    """Records of the same words, in any order, are compared as one, and leaving off where no record can come among the best changes no result, at any least score."""
    from kinfold.operators import retrieval as R
    from pyspark.sql import functions as F

    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(60)]
    names = [[rng.choice(words) for _ in range(rng.randrange(0, 6))] for _ in range(300)]
    rows = [(i, rng.sample(n, len(n))) for i, n in enumerate(names + names[:200] + names[:40] + [["same", "name"]] * 60)]
    rng.shuffle(rows)
    of = lambda rows: spark.createDataFrame(rows, "id long, tokens array<string>")
    q, c = of(rows[:150]), of(rows[150:])
    found = lambda df: sorted((r.qid, r["rank"], r.cid, r.score) for r in df.collect())
    for least, top in ((0.05, 6), (0.05, 25), (0.6, 6), (0.85 - 5e-7, 25)):
        want = found(R.tfidf_join(q, c, len(rows) - 150, top=top, least=least))
        assert found(R.tfidf_top(q, c, len(rows) - 150, top=top, least=least, block=40, cell=120)) == want and want
    plan = plan_of(R.tfidf_top(q, c, len(rows) - 150))
    assert "(qid#" in plan and " = of#" in plan  # a class is asked by one of its records


def test_addresses_are_shuffled_part_by_part(spark, monkeypatch):
    """Queries on whole addresses take the reference records in parts, each pair is in one of them, and nothing is left to shuffle after."""
    from kinfold.operators import features as X
    from kinfold.plans import queries as Q

    asked = []
    for name in ("address", "address_scores"):
        monkeypatch.setattr(X, name, lambda b, f=getattr(X, name), name=name: (asked.append((name, b.select("s1_id").distinct().count())), f(b))[1])
    whole = Q._base(spark, SF)[0]
    for key in [k for k in Q._KEPT if k[1].startswith("feat_addr")]:
        Q._release(spark, Q._KEPT.pop(key))
    for query, name, plain in (("feat_addr", "address", X._address), ("feat_addr_token_set", "address_scores", X._address_scores)):
        got = entry.queries()[query](spark, SF)
        assert "Join" not in plan_of(got) and len([n for n, _ in asked if n == name]) == Q.PARTS
        assert sum(n for k, n in asked if k == name) == whole.select("s1_id").distinct().count() > max(n for k, n in asked if k == name)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.select("s1_id", "cand_id", *plain()).collect()))
