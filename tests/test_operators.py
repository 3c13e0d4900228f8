import itertools
import random

from kinfold.operators import blocking as B
from kinfold.operators import features as X
from kinfold.operators import learn as L
from kinfold.operators import selection as S
from kinfold.plans import fixtures as fx
from kinfold.sources import io

SF = "/root/testdata/sf0.001"
PROBS = "s1_id string, cand_id string, p double"


def expected(ps, k):
    total = 0.0
    for hit in itertools.product((0, 1), repeat=len(ps)):
        w = 1.0
        for p, h in zip(ps, hit):
            w *= p if h else 1 - p
        m, h = sum(hit), sum(hit[:k])
        total += w * ((m == 0) if k == 0 else 1.25 * h / (k + 0.25 * m))
    return total


def test_exact_cut_values(spark):
    lists = [[0.97, 0.92, 0.55, 0.20, 0.05], [0.30, 0.10, 0.05], [0.99], [0.05], [0.95, 0.9, 0.02]]
    rows = [(str(i), f"c{j}", p) for i, ps in enumerate(lists) for j, p in enumerate(ps)]
    df = spark.createDataFrame(rows, PROBS)
    chosen = {}
    for r in S.select_exact(df).collect():
        chosen.setdefault(r.s1_id, set()).add(r.cand_id)
    assert [len(chosen.get(str(i), ())) for i in range(5)] == [2, 0, 1, 0, 2]
    es = spark.createDataFrame([(lists[0],)], "ps array<double>").select(S.expected_f05(__import__("pyspark").sql.functions.col("ps")).alias("e")).first().e
    assert [round(x.e, 3) for x in es] == [0.001, 0.730, 0.883, 0.824, 0.700, 0.588]
    for x in es:
        assert abs(x.e - expected(lists[0], x.k)) < 1e-9


def test_repair_leaves_one_owner(spark):
    rng = random.Random(5)
    rows = {(f"s{rng.randrange(60)}", f"c{rng.randrange(80)}"): rng.random() for _ in range(250)}
    df = spark.createDataFrame([(*k, p) for k, p in rows.items()], PROBS).persist()
    out = S.repair(df, S.select_approximate).collect()
    assert len({r.cand_id for r in out}) == len(out)


def test_f05_examples(spark):
    chosen = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "3"), ("c", "9")], "s1_id string, cand_id string")
    truth = spark.createDataFrame([("a", "1"), ("a", "2")], "s1_id string, cand_id string")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "s1_id string")
    got = {r.s1_id: round(r.f05, 3) for r in S.f05(chosen, truth, ids).collect()}
    assert got == {"a": 0.714, "b": 1.0, "c": 0.0}


def test_rivals_match_the_plain_join(spark):
    s1, pool = fx.split(spark, SF)
    index = B.Index(pool)
    b = X.base(index.scheme("a", s1), s1, pool).persist()
    fast = {(r.s1_id, r.cand_id): (r.x_rival_addr, r.x_rival_num) for r in X.rivals(b, s1).collect() if r.x_rival_addr is not None}
    slow = {(r.s1_id, r.cand_id): (r.x_rival_addr, r.x_rival_num) for r in X.rivals_plain(b, s1).collect()}
    assert fast == slow and slow


def test_rivals_of_names_that_many_share(spark):
    """A name of more reference records than one row lists has rivals too, the best of all of them, in whatever cells they lie."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    some = lambda n, of: [rng.choice(of) for _ in range(rng.randrange(n))]
    words, nums = [f"w{i}" for i in range(14)], [f"{i}" for i in range(25)]
    kind = "entity_id string, country string, name_key string, addr_tokens array<string>, addr_nums array<string>"
    make = lambda p, n, names: [(f"{p}{i:03d}", "en", names[i % len(names)], some(6, words), some(3, nums)) for i in range(n)]
    refs = make("r", X.RIVALS + 40, ["many"]) + [(f"q{i}", "en", "many", ["w1", "w2"], ["7"]) for i in range(3)] + make("f", 12, ["few", "lone", ""])
    s1, pool = spark.createDataFrame(refs, kind), spark.createDataFrame(make("c", 40, ["many", "many", "few", "none", ""]) + [("d0", "en", "many", ["w1", "w2"], ["7"])], kind)
    side = lambda df, key, p: df.select(F.col("entity_id").alias(key), F.col("country").alias(f"{p}_country"), F.col("name_key").alias(f"{p}_key"), F.array_distinct("addr_tokens").alias(f"{p}_atok"), F.array_distinct("addr_nums").alias(f"{p}_num"))
    b = side(s1, "s1_id", "s").crossJoin(side(pool, "cand_id", "c")).persist()
    found = lambda df: {(r.s1_id, r.cand_id): (r.x_rival_addr, r.x_rival_num) for r in df.collect() if r.x_rival_addr is not None}
    want = found(X.rivals_plain(b, s1))
    assert found(X.rivals(b, s1)) == found(X.rivals(b, s1, pool)) == want and sum(c == "d0" for _, c in want) == len(refs)
    many = s1.filter("name_key = 'many'")
    asked = side(pool, "cand_id", "c").select("cand_id", F.col("c_country").alias("country"), F.col("c_key").alias("name_key"), "c_atok", "c_num")
    fits = {r.cand_id: r.fits for r in X._best_fits(asked, many, block=5, cell=7).collect()}
    own = {k: v for k, v in want.items() if k[1] in fits}
    assert len(own) == len(fits) * len(refs) and own == {k: tuple(max(x[f] for x in fits[k[1]] if x["of"] != k[0]) for f in ("addr", "num")) for k in own}


def test_retrieval_forms_agree(spark):
    from kinfold.operators import retrieval as R

    rng = random.Random(4)
    vectors = [(i, f"g{i % 3}", [rng.randrange(-50, 50) for _ in range(6)]) for i in range(90)]
    q = spark.createDataFrame(vectors[:30], "qid long, grp string, v array<long>")
    c = spark.createDataFrame(vectors[30:], "cid long, grp string, v array<long>")
    rows = lambda df: sorted((r.qid, r["rank"], r.cid, float(r.score)) for r in df.collect())
    assert rows(R.knn(q, c, 4, block=7, cell=5)) == rows(R.knn_sql(q, c, 4))
    names = [(i, ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(0, 4))]) for i in range(120)]
    of = lambda rows: spark.createDataFrame(rows, "id long, tokens array<string>")
    for max_df in (None, 6):
        one, two = (sorted((r.qid, r["rank"], r.cid, r.score) for r in f(of(names[:40]), of(names[40:]), 80, top=7, max_df=max_df, **kw).collect()) for f, kw in ((R.tfidf_top, {"block": 9, "cell": 13}), (R.tfidf_join, {})))
        assert one == two and one
    assert R.tfidf_top(of([]), of(names), 120).count() == 0 and R.tfidf_top(of(names), of([]), 0).count() == 0
    texts = spark.createDataFrame([(1, "abcd"), (2, "abcd"), (3, None), (4, "zzzz")], "id long, t string")
    v = {r.id: r.v for r in R.hashed_embedding(texts, "t", 64).collect()}
    assert v[1] == v[2] and abs(sum(x * x for x in v[1]) - 1) < 1e-5 and v[3] is not None
    pairs = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.2), ("b", "x", 0.9)], "s1_id string, cand_id string, p double")
    ann = spark.createDataFrame([("a", "x", 0.9, 1), ("a", "z", 0.8, 2), ("c", "x", 0.7, 1)], "s1_id string, cand_id string, ann_score double, ann_rank int")
    alone = {(r.s1_id, r.cand_id): (r.p, round(r.ann_gap, 6)) for r in R.with_ann(pairs, ann, pairs, 5)["alone"].collect()}
    assert alone == {("a", "x"): (0.9, 0.0), ("a", "z"): (0.8, 0.1)}
    o = {(r.s1_id, r.cand_id): (r.o_score, r.o_rank, r.o_gap) for r in R.with_original(pairs, ann).collect()}
    assert o == {("a", "x"): (0.9, 1, 0.0), ("a", "y"): (None, None, None), ("b", "x"): (None, None, None)}


def test_shards_give_the_same_and_resume(spark, tmp_path):
    s1, pool = fx.split(spark, SF)
    index = B.Index(pool)
    work = lambda part: index.scheme("b", part).select("s1_id", "cand_id", "rk")
    path = str(tmp_path / "out")
    once = io.run_shards(spark, s1, 3, path, work).select("s1_id", "cand_id", "rk").collect()
    again = io.run_shards(spark, s1, 3, path, lambda part: 1 / 0).select("s1_id", "cand_id", "rk").collect()
    whole = work(s1).collect()
    assert sorted(once) == sorted(again) == sorted(whole)


def test_tsv_round_trip(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("\tbusiness_name\tbusiness_address\tcountry\nS1-1\tAcme \"Q\t\tus\nS1-2\t\tRoad\tfr\n")
    rows = io.read_source(spark, str(tmp_path / "s.tsv")).orderBy("entity_id").collect()
    assert [tuple(r) for r in rows] == [("S1-1", 'Acme "Q', "", "us"), ("S1-2", "", "Road", "fr")]
    (tmp_path / "t.tsv").write_text("a\tb\nS1-1\tS2-1, S3-2\nS1-2\t\n")
    assert {tuple(r) for r in io.read_truth(spark, str(tmp_path / "t.tsv")).collect()} == {("S1-1", "S2-1"), ("S1-1", "S3-2")}
    pairs = spark.createDataFrame([("S1-1", "S3-2"), ("S1-1", "S2-1")], "s1_id string, cand_id string")
    ids = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    lines = io.match_lines(ids, pairs, "matched_entity_ids")
    assert {tuple(r) for r in lines.collect()} == {("S1-1", "S2-1,S3-2"), ("S1-2", "")}
    pool = spark.createDataFrame([("S2-1",), ("S3-2",)], "entity_id string")
    bad = io.validate(ids, lines, lines.withColumnRenamed("matched_entity_ids", "candidate_entity_ids"), pool)
    assert set(bad.values()) == {0}


def test_exact_keys_with_many_records(spark):
    """The pool is limited key by key before the join; the ranks are those of the whole join."""
    rng = random.Random(2)
    rows = lambda side, n: [(f"S{side}-{i:03d}", "us", rng.choice(["a b", "c"]), rng.choice(["", "1", "2"]), rng.choice([["ab", "cd"], ["abcd"], ["x"]])) for i in range(n)]
    schema = "entity_id string, country string, name_key string, postcode string, name_tokens array<string>"
    left, right = rows(1, 12), rows(2, 60)
    for r in (s1 := spark.createDataFrame(left, schema)), (pool := spark.createDataFrame(right, schema)):
        r.persist()
    index = B.Index.__new__(B.Index)
    index.pool, index.knobs = pool, B.Knobs(key_cap=7)
    for name, key, least in (("a", lambda r: r[2], 1), ("a2", lambda r: "".join(r[4]), 4)):
        want = set()
        for s in left:
            same = sorted(((name == "a" and not (c[3] and c[3] == s[3])), c[0]) for c in right if key(c) == key(s) and len(key(s)) >= least)
            want |= {(s[0], c, i) for i, (_, c) in enumerate(same[:7], 1)}
        assert {(r.s1_id, r.cand_id, r.rk) for r in index.scheme(name, s1).collect()} == want


def test_winner_rule():
    assert L.choose({"ref": [1, 1, 1, 1, 1], "new": [2, 2, 2, 2, 0]}, "ref") == "new"
    assert L.choose({"ref": [1, 1, 1, 1, 1], "new": [9, 2, 2, 0, 0]}, "ref") == "ref"


def test_stream_gives_the_batch_result(spark, tmp_path):
    from kinfold.streaming.resolve import stream_candidates

    s1, pool = fx.split(spark, SF)
    index = B.Index(pool)
    few = s1.limit(5).drop("side", "text_md5")
    few.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(few.schema).parquet(str(tmp_path / "in"))
    stream_candidates(stream, index, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("s1_id", "cand_id", "rnk").collect()
    want = B.top_k(B.union(spark.read.parquet(str(tmp_path / "in")), index), 100).select("s1_id", "cand_id", "rnk").collect()
    assert sorted(got) == sorted(want)


def test_schemes_of_names_go_class_by_class(spark):
    """Records of one name are joined once: the join has a row for each pair of names that share a word, not one for each pair of records."""
    rng = random.Random(5)
    words = [["ab", "cd"], ["ab", "cde"], ["cd", "ab"], ["xyz", "ab", "ab"], ["q", "cde"], [], None]
    schema = "entity_id string, country string, name_tokens array<string>, addr_tokens array<string>, addr_nums array<string>, postcode string"
    rows = lambda side, n: [(f"S{side}-{i:03d}", rng.choice(["us", "us", "fr", None]), rng.choice(words), ["w"], [], "") for i in range(n)]
    left, right = rows(1, 60), rows(2, 240)
    s1, pool = (spark.createDataFrame(r, schema).coalesce(1) for r in (left, right))
    index = B.Index(pool, B.Knobs(scheme_cap=9))
    joined = []
    taken = lambda name, records: (lambda q: (joined.append(q.count()), q)[1])(B.Index.query(index, name, records))
    index.query = taken
    pairs = lambda ks: [f"{a}|{b}" for a in ks for b in ks if b > a]
    heard = lambda t: t.replace("sh", "s").replace("ph", "f").translate(str.maketrans("c", "k", "aeiou"))
    df = {}
    for r in right:
        for t in r[2] or []:
            df[r[1], t] = df.get((r[1], t), 0) + 1
    rare = lambda r, n: sorted([t for t in r[2] or [] if (r[1], t) in df], key=lambda t: (df[r[1], t], t))[:n]
    for name, of, n in (("b", lambda r: r[2] or [], 3), ("c", lambda r: [k for t in r[2] or [] if len(k := heard(t)) >= 3], 3), ("f", lambda r: pairs(rare(r, 4)), 6)):
        count = {}
        for r in right:
            for k in of(r):
                count[r[1], k] = count.get((r[1], k), 0) + 1
        idf = {r.country + r.key: r.idf for r in getattr(index, {"b": "tok_stats", "c": "skel_stats", "f": "pair_stats"}[name]).filter("country IS NOT NULL").collect()}
        want = set()
        for s in left:
            asked = sorted([k for k in of(s) if (s[1], k) in count], key=lambda k: (count[s[1], k], k))[:n] if s[1] else []
            found = []
            for c in right:
                if c[1] == s[1]:
                    hits = [k for k in asked for other in of(c) if other == k]
                    if hits:
                        found.append((-sum(idf[s[1] + k] for k in hits), -len(hits), c[0]))
            want |= {(s[0], c, -w, -m, i) for i, (w, m, c) in enumerate(sorted(found)[:9], 1)}
        got = {(r.s1_id, r.cand_id, r.idf_score, r.shared, r.rk) for r in index.scheme(name, s1).collect()}
        assert got == want and (want or name == "c"), name
    assert sum(joined) <= 2 * (3 + 3 + 6) * len(words)  # 60 records, two countries
    index.discard()
