import random

import pytest

from kinfold.functions import text as TX
from kinfold.operators import blocking as B
from kinfold.operators import features as X
from kinfold.operators import learn as L
from kinfold.operators import sampling as P
from kinfold.operators import selection as S
from kinfold.plans import run
from kinfold.sources import io

WORDS = [a + b for a in "bal cor dan fel gor hin jal kem lor mun nar pol".split() for b in "ton der vik sa lan mir".split()]


def files(tmp_path, n=90):
    """Reference records and two pool files: two thirds have one or two noisy copies, the rest of the pool is strangers."""
    rng = random.Random(3)
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry"
    ref, pools, truth = [head], {2: [head], 3: [head]}, ["source1_entity_id\tmatched_entity_ids"]
    order = list(range(n))
    rng.shuffle(order)
    for i in order:
        name = [rng.choice(WORDS) for _ in range(3)]
        street, number, post = rng.choice(WORDS), rng.randrange(1, 900), 10000 + 7 * i
        ref.append(f"S1-{i:04d}\t{' '.join(name).title()} Ltd.\t{number} {street.title()} St, {post}\tus")
        own = []
        for side in (2, 3):
            if rng.random() < 0.55:
                own.append(f"S{side}-{i:04d}")
                other = name if rng.random() < 0.5 else name[::-1]
                pools[side].append(f"{own[-1]}\t{' '.join(other)} limited\t{number} {street} street {post}\tus")
            stranger = " ".join(rng.choice(WORDS) for _ in range(3))
            pools[side].append(f"S{side}-x{i:03d}\t{stranger}\t{rng.randrange(1, 900)} {rng.choice(WORDS)} road\tus")
        truth.append(f"S1-{i:04d}\t{','.join(own)}")
    for name, lines in (("s1", ref), ("s2", pools[2]), ("s3", pools[3]), ("truth", truth)):
        (tmp_path / f"{name}.tsv").write_text("\n".join(lines) + "\n")
    return [line.split("\t")[0] for line in ref[1:]]


def test_a_whole_linkage(spark, tmp_path):
    ids = files(tmp_path)
    at = run.Settings(str(tmp_path / "work"), shards=1, trees={"depth": 3, "rounds": 4}, conf={"spark.sql.shuffle.partitions": "2"})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    where = [str(tmp_path / "s2.tsv"), str(tmp_path / "s3.tsv")]
    bad = run.link(spark, str(tmp_path / "s1.tsv"), where, at, truth=str(tmp_path / "truth.tsv"))
    assert set(bad.values()) == {0} and spark.conf.get("spark.sql.shuffle.partitions") == before
    assert run.resumed(spark, at) == ["reference", "features", "probabilities", "matching_results", "candidate_pairs"]
    out = {}
    for name in ("matching_results", "candidate_pairs"):
        (part,) = (tmp_path / "work" / "version=1" / name).glob("part-*.csv")
        lines = [line.split("\t") for line in part.read_text().splitlines()[1:]]
        assert [line[0] for line in lines] == ids  # in the file's order
        out[name] = {line[0]: line[1].split(",") if line[1] else [] for line in lines}
    want = {a: (b.split(",") if b else []) for a, b in (line.split("\t") for line in (tmp_path / "truth.tsv").read_text().splitlines()[1:])}
    right = sum(out["matching_results"][i] == want[i] for i in ids)
    assert right >= 0.8 * len(ids)
    # the second run finds every table made and uses the model that the first kept
    again = run.link(spark, str(tmp_path / "s1.tsv"), where, at)
    assert again == bad
    tight = run.Settings(str(tmp_path / "tight"), knobs=B.Knobs(pair_budget=3))
    with pytest.raises(RuntimeError, match="budget"):
        run.link(spark, str(tmp_path / "s1.tsv"), where, tight)


def test_matrix_and_learning(spark, tmp_path):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    m = entry.queries()["feature_matrix"](spark, sf)
    assert m.columns == ["s1_id", "cand_id", *X.FEATURES] and len(X.FEATURES) == 52
    assert {t for _, t in m.dtypes[2:]} == {"float"}
    pairs = entry.queries()["topk"](spark, sf)
    n = m.count()
    assert n >= pairs.count() and m.select("s1_id", "cand_id").distinct().count() == n
    # each column is what its own query says
    for name, columns in (("feat_name_sets", ["n_jacc", "n_len_ratio", "n_suffix_agree"]), ("feat_leftover", ["n_extra_cnt", "n_missing_max_idf"]), ("feat_idf_cover", ["n_idf_cover_c"]), ("feat_rival", ["x_rival_addr", "x_c_name_s1cnt"]), ("feat_partial", ["n_partial"])):
        own = {(r.s1_id, r.cand_id): [r[c] for c in columns] for r in entry.queries()[name](spark, sf).collect()}
        for r in m.select("s1_id", "cand_id", *columns).collect():
            for got, want in zip(r[2:], own[r.s1_id, r.cand_id]):
                assert (got is None) == (want is None) and (got is None or abs(got - want) <= 1e-5 * max(1, abs(want))), (name, r)
    first = m.filter("g_is_top = 1").groupBy("s1_id").count()
    assert first.filter("count > 1").count() == 0 and first.count() == m.select("s1_id").distinct().count()
    X.write_matrix(m, str(tmp_path / "m"), n)
    with pytest.raises(RuntimeError):
        X.write_matrix(m, str(tmp_path / "m"), n + 1)

    few = ["n_jacc", "n_idf_cover_s1", "x_rival_addr"]
    truth = m.filter("n_jacc = 1").select("s1_id", "cand_id")
    rows, names = L.without_nulls(L.split_by_entity(L.labelled(m, truth)).select("s1_id", "cand_id", "fold", "y", *few), few)
    assert names == [*few, *[f"{c}__null" for c in few]]
    assert rows.groupBy("s1_id").agg({"fold": "max"}).count() == rows.select("s1_id", "fold").distinct().count()
    model = L.fit_trees(rows, names, depth=2, rounds=3)
    scored = L.predicted(model, rows)
    calibration = L.calibrate(scored)
    quality = L.quality(scored)
    assert quality["roc_auc"] > 0.95 and quality["pr_auc"] > 0.9
    assert L.importance(model, names)[0][0] in few
    L.save(model, calibration, names, str(tmp_path / "model"))
    loaded, again, kept = L.load(str(tmp_path / "model"))
    assert kept == names
    a, mass = L.score_pairs(model, calibration, rows)
    b, _ = L.score_pairs(loaded, again, rows)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.filter("p < 0.01 or p > 1").count() == 0
    assert mass.count() == rows.select("s1_id").distinct().count()
    ids = rows.select("s1_id").distinct()
    results = L.cross_validated(rows, names, truth, ids, {"reference": {"depth": 1, "rounds": 1}, "more": {"depth": 2, "rounds": 2}}, folds=2)
    assert {k: len(v) for k, v in results.items()} == {"reference": 2, "more": 2} and L.choose(results, "reference", 2) in results
    assert set(L.PARAMETER_SETS) >= {"reference"} and len(L.PARAMETER_SETS) == 5


def plain_features(s, c, pair, df, total, names, rivals):
    """The features of one pair, record by record, without any table. df: (country, word): occurrences in the pool."""
    import math

    from kinfold.functions import similarity as sim

    idf = lambda w: math.floor(math.log(1 + total / df[s["country"], w]) * 1e6 + 0.5) if (s["country"], w) in df else None
    weight = lambda ws: sum(idf(w) or 0 for w in ws)
    jac = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0

    def sound(w):
        import re

        for pattern, to in TX.SOUND_RULES:
            w = re.sub(pattern, to.replace("$1", r"\1"), w)
        return w

    st, ct = set(s["name_tokens"]), set(c["name_tokens"])
    ss, cs = ({k for k in map(sound, x) if len(k) >= 2} for x in (st, ct))
    sa, ca, sn, cn = (set(r[f]) for f in ("addr_tokens", "addr_nums") for r in (s, c))
    sf, cf = (set(r["name_suffix"].split()) for r in (s, c))
    lone = lambda own, other, heard: [w for w in own if w not in other and sound(w) not in heard]
    extra, missing = lone(ct, st, ss), lone(st, ct, cs)
    heaviest = lambda ws: max((16_000_000 if idf(w) is None else idf(w) for w in ws), default=0)
    a, b = s["name_text"], c["name_text"]
    key, same = (c["country"], c["name_key"]), rivals.get((c["country"], c["name_key"]), [])
    others = [r for r in same if r["entity_id"] != s["entity_id"]] if len(same) <= 50 else []
    best = max((jac(set(r["addr_tokens"]), ca) for r in others), default=None)
    flags = [pair[f"by_{n}"] for n in B.SCHEMES]
    return {
        "n_token_set": sim.token_set_ratio(a, b), "n_token_sort": sim.token_sort_ratio(a, b), "n_partial": sim.partial_ratio(a, b), "n_jaro": sim.jaro_winkler(a, b), "n_prefix": sim.ratio(a[:12], b[:12]),
        "n_jacc": jac(st, ct), "n_idf_cover_s1": weight(st & ct) / weight(st) if weight(st) else 0.0, "n_idf_cover_c": weight(st & ct) / weight(ct) if weight(ct) else 0.0,
        "n_len_ratio": min(len(a), len(b)) / max(len(a), len(b)) if a or b else 0.0, "n_tok_diff": abs(len(st) - len(ct)), "n_exact_key": s["name_key"] == c["name_key"] != "",
        "n_suffix_agree": bool(sf & cf), "n_suffix_conflict": bool(sf and cf and not sf & cf), "n_skel_jacc": jac(ss, cs), "n_skel_ratio": sim.ratio(" ".join(sorted(ss)), " ".join(sorted(cs))),
        "n_extra_cnt": len(extra), "n_extra_max_idf": heaviest(extra), "n_missing_cnt": len(missing), "n_missing_max_idf": heaviest(missing),
        "a_token_set": sim.token_set_ratio(" ".join(sa), " ".join(ca)), "a_jacc": jac(sa, ca), "a_post_match": s["postcode"] == c["postcode"] != "", "a_post_both": s["postcode"] != "" != c["postcode"],
        "a_num_overlap": jac(sn, cn), "a_num_both": bool(sn and cn), "a_empty_either": s["addr_empty"] or c["addr_empty"], **{f"b_by_{n}": f for n, f in zip(B.SCHEMES, flags)}, "b_n_schemes": sum(flags),
        "b_idf_score": pair["idf_score"], "b_shared": pair["shared"], "b_containment": pair["containment"] or 0.0, "b_rank": pair["rnk"], "c_source": int(c["entity_id"][1]), "c_same_country": s["country"] == c["country"],
        "x_s1_name_dup": max(1, names.get((s["country"], s["name_key"]), 0)), "x_c_name_s1cnt": names.get(key, 0), "x_rival_addr": best,
        "x_rival_addr_adv": None if best is None else best - jac(sa, ca), "x_rival_num": max((bool(set(r["addr_nums"]) & cn) for r in others), default=None),
    }


def test_matrix_against_plain_pairs(spark):
    from collections import Counter

    import __spark_entry__ as entry
    from kinfold.plans import fixtures as fx

    sf = "/root/testdata/sf0.001"
    rec = {r.entity_id: r.asDict() for r in fx.records(spark, sf).collect()}
    s1, pool = ([r for r in rec.values() if (r["side"] == 0) == own] for own in (True, False))
    df = Counter((r["country"], w) for r in pool for w in r["name_tokens"])
    named = {}
    for r in s1:
        if r["name_key"]:
            named.setdefault((r["country"], r["name_key"]), []).append(r)
    names = {k: len(v) for k, v in named.items()}
    pairs = {(r.s1_id, r.cand_id): r for r in entry.queries()["union_fair"](spark, sf).filter("rnk <= 100").collect()}
    got = {(r.s1_id, r.cand_id): r for r in entry.queries()["feature_matrix"](spark, sf).collect()}
    assert set(got) == set(pairs)
    lists = {}
    for k, pair in pairs.items():
        want = plain_features(rec[k[0]], rec[k[1]], pair, df, len(pool), names, named)
        lists.setdefault(k[0], []).append((-(0.6 * want["n_token_set"] + 0.4 * want["n_idf_cover_s1"]), k[1]))
        for column, value in want.items():
            own = got[k][column]
            assert (own is None) == (value is None) and (own is None or abs(own - float(value)) <= 1e-4 * max(1.0, abs(float(value)))), (k, column, own, value)
    for s, own in lists.items():
        own.sort()
        for i, (score, c) in enumerate(own, 1):
            r = got[s, c]
            assert r.g_n_cands == len(own) and abs(r.g_rank_frac - i / len(own)) < 1e-5 and r.g_is_top == (i == 1) and abs(r.g_score_margin - (own[0][0] - score)) < 1e-5


def test_repairs_choose_the_right_owner(spark):
    rows = [("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.7), ("b", "z", 0.95), ("c", "z", 0.95), ("c", "w", 0.6)]
    probs = spark.createDataFrame(rows, "s1_id string, cand_id string, p double")
    for mode in ("accumulate", "restart"):
        got = {r.cand_id: r.s1_id for r in S.repair(probs, lambda d: S.select_threshold(d, 0.5), mode=mode).collect()}
        assert got == {"x": "a", "y": "a", "z": "b", "w": "c"}


def test_repair_against_a_plain_loop(spark):
    rng = random.Random(11)
    rows = {(f"s{rng.randrange(25)}", f"c{rng.randrange(30)}"): round(rng.random(), 3) for _ in range(160)}

    def choose(lists):
        out = set()
        for s, own in lists.items():
            own = sorted(own, key=lambda x: (-x[1], x[0]))
            total, best, run_sum, none = sum(p for _, p in own), (-1.0, 0), 0.0, 1.0
            for k, (_, p) in enumerate(own, 1):
                run_sum += p
                none *= 1 - p
                score = 1.25 * run_sum / (k + 0.25 * total)
                best = max(best, (score, -k))
            if own and none <= best[0]:
                out |= {(s, c, p) for c, p in own[: -best[1]]}
        return out

    left = {}
    for (s, c), p in rows.items():
        left.setdefault(s, []).append((c, p))
    chosen = choose(left)
    for _ in range(5):
        owner = {}
        for s, c, p in chosen:
            owner[c] = min(owner.get(c, (2, "")), (-p, s))
        lost = {(s, c) for s, c, _ in chosen if owner[c][1] != s}
        if not lost:
            break
        hurt = {s for s, _ in lost}
        left = {s: [x for x in own if (s, x[0]) not in lost] for s, own in left.items()}
        chosen = {x for x in chosen if x[0] not in hurt} | choose({s: left[s] for s in hurt})
    df = spark.createDataFrame([(*k, p) for k, p in rows.items()], "s1_id string, cand_id string, p double")
    assert {tuple(r) for r in S.repair(df, S.select_approximate).collect()} == chosen


def test_sources(spark, tmp_path):
    import pyarrow as pa

    a, b = spark.range(4).withColumnRenamed("id", "k").selectExpr("k", "k * 2 AS v"), spark.range(4, 8).withColumnRenamed("id", "k").selectExpr("k", "k * 2 AS v")
    io.write_table(a, str(tmp_path / "a"), ["v", "k"])
    io.append_table(a, str(tmp_path / "ab"))
    io.append_table(b, str(tmp_path / "ab"))
    io.write_table(b, str(tmp_path / "b"))
    df = io.read_tables(spark, str(tmp_path / "a"), str(tmp_path / "b"), columns=["k"], where={"k": [1, 5]})
    assert sorted(r.k for r in df.collect()) == [1, 5] and df.columns == ["k"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "In(k" in plan and "ReadSchema: struct<k:bigint>" in plan
    assert spark.read.parquet(str(tmp_path / "ab")).count() == 8
    io.registered(spark, pa.table({"x": [1, 2, 3]}), "numbers")
    assert spark.sql("SELECT sum(x) AS s FROM numbers").first().s == 6
    assert io.versioned("w/", 3) == "w/version=3"
    (tmp_path / "s.tsv").write_text("\tbusiness_name\tbusiness_address\tcountry\nS1-9\tA\tx\tus\nS1-1\tB\ty\tus\n")
    assert [r.entity_id for r in io.read_column(spark, str(tmp_path / "s.tsv")).collect()] == ["S1-9", "S1-1"]
    lines = spark.createDataFrame([("S1-1", "b"), ("S1-9", "a")], "source1_entity_id string, m string")
    assert [r.m for r in io.in_file_order(lines, io.with_row_order(io.read_source(spark, str(tmp_path / "s.tsv")))).collect()] == ["a", "b"]
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-9", "S2-1"), ("S1-9", "S2-2")], "s1_id string, cand_id string")
    assert tuple(io.exclusive(truth).first()) == (2, 1)
    (tmp_path / "t.tsv").write_text("a\tb\nS1-1\tS2-1, S3-2\nS1-2\tS2-9\n")
    some = spark.createDataFrame([("S1-2",)], "entity_id string")
    assert [tuple(r) for r in io.read_truth(spark, str(tmp_path / "t.tsv"), some).collect()] == [("S1-2", "S2-9")]


def test_intermediates_lie_in_the_shared_folder_and_go(spark):
    import os

    from kinfold import session

    df, path = session.written(spark.range(3), "one")
    by, named = session.written_by(spark.range(6).selectExpr("id", "id % 2 AS k"), "two", "k", 2)
    for p in (path, named):
        assert p.startswith(session.shared_dir(spark)) and os.path.isdir(p.removeprefix("file:").replace("//", "/"))
    assert df.count() == 3 and by.count() == 6 and any(t.name.startswith("kinfold_two_") for t in spark.catalog.listTables())
    session.discard(spark, named)
    assert not os.path.exists(named.removeprefix("file:")) and not any(t.name.startswith("kinfold_two_") for t in spark.catalog.listTables())
    session.discard(spark, path)


def test_faults_that_the_validator_counts(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "entity_id string")
    matches = spark.createDataFrame([("a", "x,y"), ("b", "x"), ("b", "")], "source1_entity_id string, matched_entity_ids string")
    candidates = spark.createDataFrame([("a", "x"), ("b", "x")], "source1_entity_id string, candidate_entity_ids string")
    pool = spark.createDataFrame([("x",)], "entity_id string")
    assert io.validate(ids, matches, candidates, pool) == {"missing": 1, "repeated": 1, "not_candidates": 1, "unknown": 1, "owners": 1}


def test_samples_are_the_same_on_every_run(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    one, two = ([r.k for r in P.sample_rows(df.repartition(n), 25, "k").collect()] for n in (1, 7))
    assert one == two and len(set(one)) == 25
