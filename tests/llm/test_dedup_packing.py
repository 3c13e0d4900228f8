import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import xxhash
from kinfold.llm import components, packing, simhash
from kinfold.llm.tokens import ChunkEncoder, rank_encoder
from pyspark.sql import functions as F
from tokenizers import Tokenizer


def plain_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, near=2):
    """Smallest member that each distinct fingerprint reaches."""
    todo, root = set(fps), {}
    for f in sorted(todo):
        if f in root:
            continue
        heap = [f]
        root[f] = f
        while heap:
            x = heap.pop()
            for y in todo:
                if y not in root and (x ^ y).bit_count() <= near:
                    root[y] = f
                    heap.append(y)
    return root


def plain_classes(texts, words=5, least=0.8):
    """Lists of positions: texts that reach each other by links of that similarity of their shingles, all pairs compared."""
    sets = []
    for t in texts:
        w = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")).encode().split()
        sets.append({b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            common, both = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if (common >= least * both - 1e-9) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return [[i for i, g in enumerate(group) if g == k] for k in set(group)]


TEXTS = [None, "", " \t", "A b C", "a B c", "a b", "É b c d", "é b c d", "w " * 40, "x\x0by z", "x y z", "one two three four five six seven"]


def test_fingerprints_and_components(spark, clashing):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choice(words) for _ in range(300)]
    near = []
    for _ in range(40):
        v = list(base)
        v[rng.randrange(300)] = rng.choice(words)
        near.append(" ".join(v))
    texts = TEXTS + near + near[:5] + [" ".join(rng.choice(words) for _ in range(20)) for _ in range(30)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "a b c"), (None, "lonely words here now"), (7, "again")]
    got = simhash.near_duplicates(clashing(docs)).collect()
    assert len(got) == len(docs)
    want = [plain_fingerprint(t) for _, t in docs]
    root = classes(want)
    least = {}
    for (k, _), f in zip(docs, want):
        if k is not None:
            least[root[f]] = min(least.get(root[f], 1 << 60), k)
    mask = (1 << 64) - 1
    assert sorted((str(r.doc_id), r.fp & mask, str(r.component_id)) for r in got) == sorted((str(k), f, str(least.get(root[f]))) for (k, _), f in zip(docs, want))
    kept = simhash.keep_one_of_each(clashing(docs[:-1])).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(min((docs[i][0] is None, docs[i][0]) for i in own)[1]) for own in plain_classes([t for _, t in docs[:-1]]))
    assert kept[0].shard == "mine" and simhash.keep_one_of_each(clashing(docs).limit(0)).count() == 0
    assert simhash.near_duplicates(clashing(docs).limit(0)).count() == 0


def test_runs_of_any_length(spark):
    rng = random.Random(9)
    seeds = [rng.getrandbits(64) for _ in range(3)]
    fps = {s ^ rng.getrandbits(11) for s in seeds for _ in range(120)} | {rng.getrandbits(64) for _ in range(100)}
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long").persist()
    want = {}
    for f, r in classes(fps).items():
        want.setdefault(r, set()).add(f)
    for longest in (4, 30, 512):
        roots = {r.id: r.root for r in components.connected_components(simhash.near_links(df, longest)).collect()}
        got = {}
        for f in fps:
            s = int(np.uint64(f).view(np.int64))
            got.setdefault(roots.get(s, s), set()).add(f)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())), longest


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, k) for k in range(200, 260)] + [(5, 5), (300, 1)]
    got = {r.id: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(101, 141)} == {100} and {got[k] for k in [*range(200, 260), 300]} == {1} and 5 not in got
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_chunks_encode_as_the_library():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    one = rank_encoder(t.get_vocab(with_added_tokens=False), P.PATTERN)
    coder = ChunkEncoder(lambda xs: list(map(one, xs)), P.PATTERN, entries=40, longest=6)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab  \n\t'sé１　x1!\x00\x1c\x85\r😀") for _ in range(rng.randrange(60))) for _ in range(800)]
    for x in [*texts, "", " ", "\n", "a\n", " a", "it's we'll", "<|endoftext|> x", "y" * 3000]:
        assert np.frombuffer(coder.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def check_packed(rows, ids, capacity):
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    for k, own in by.items():
        own.sort(key=lambda r: r.piece)
        at = 0
        for i, r in enumerate(own):
            assert (r.piece, r.start) == (i, at) and 0 < r.length <= capacity
            at += r.length
            assert zlib.crc32(np.array(ids[k][r.start : at], "<u4").tobytes()) == r.ids_crc32
        assert at == len(ids[k]) and all(r.length == capacity for r in own[1:])
    for own in seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(seq)


def test_packing(spark, clashing):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["alpha", "be", "gamma,"]) for _ in range(rng.randrange(60)))) for i in range(120)] + [(500, None), (501, ""), (502, "long " * 400)]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {k: t.encode(x or "", add_special_tokens=False).ids + [0] for k, x in docs}
    rows = packing.pack_documents(clashing(docs), capacity=64).collect()
    n = check_packed(rows, ids, 64)
    assert n <= -(-sum(map(len, ids.values())) // 64) * 1.05 + 1
    assert packing.pack_documents(clashing(docs).limit(0)).count() == 0
    twice = packing.pack_documents(clashing([(1, "same"), (1, "same"), (None, "x")])).collect()
    assert len(twice) == 3 and len({(r.sequence_id, r.offset) for r in twice}) == 3


def fewest(sizes, capacity):
    """The least number of sequences, by trying every place of each piece, longest first."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for r in sorted({r for r in rooms if r >= sizes[i]}):
            j = rooms.index(r)
            place(i + 1, rooms[:j] + [r - sizes[i]] + rooms[j + 1 :])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best[0]


def held(plan, capacity):
    got = {}
    for config, times in plan:
        assert sum(a * k for a, k in config) <= capacity and times > 0
        for a, k in config:
            got[a] = got.get(a, 0) + k * times
    return got


def test_plans_hold_every_piece():
    rng = np.random.default_rng(0)
    for n in (0, 1, 40, 3000):
        sizes = np.minimum(128, rng.lognormal(3, 1, n).astype(int) + 1)
        want = {int(a): int(b) for a, b in zip(*np.unique(sizes, return_counts=True))}
        found = packing.pack_histogram(want, 128)
        assert held(found.plan, 128) == want
        assert found.bound <= found.sequences <= found.bound + len(found.plan)
        assert found.sequences <= -(-int(sizes.sum()) // 128) * 1.02 + 2


def test_small_plans_are_the_best():
    rng = random.Random(6)
    missed = 0
    for _ in range(120):
        capacity = rng.choice([10, 20, 50])
        sizes = [rng.randrange(1, capacity + 1 if rng.random() < 0.3 else capacity // 2 + 1) for _ in range(rng.randrange(1, 10))]
        found = packing.pack_histogram({n: sizes.count(n) for n in sizes}, capacity)
        best = fewest(sizes, capacity)
        assert found.bound <= best
        missed += found.sequences > best
    assert missed == 0


def test_the_program_makes_the_plan():
    """On many pieces rounding the program makes nearly all sequences, at most one a configuration above the bound."""
    rng = np.random.default_rng(4)
    sizes = np.minimum(2048, rng.lognormal(6, 1, 60000).astype(int) + 1)
    want = {int(a): int(b) for a, b in zip(*np.unique(sizes, return_counts=True))}
    found = packing.pack_histogram(want, 2048)
    assert held(found.plan, 2048) == want
    assert found.rounded > 0.95 * (found.sequences - want.get(2048, 0))
    assert found.bound <= found.sequences <= found.bound * 1.002 + 1
    # two thirds and over a half: no two of them share a sequence, so the sum of lengths bounds badly and the prices bound well
    odd = packing.pack_histogram({1366: 300, 1056: 200, 600: 100}, 2048)
    assert odd.bound >= 495 and odd.sequences == 500


def test_null_and_repeated_ids_lose_true_duplicates_alone(spark, clashing):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    docs = [(1, a), (None, a), (None, b), (None, c), (None, c), (2, a), (2, d), (2, e), (3, e), (None, None), (None, "")]
    kept = simhash.keep_one_of_each(clashing(docs)).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted([("1", a), ("None", b), ("None", c), ("2", d), ("2", e), ("None", "")])
    assert simhash.keep_one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).count() == 6


def edited(rng, words, changes):
    v = list(words)
    for _ in range(changes):
        at = rng.randrange(len(v))
        v[at : at + 1] = rng.choice([[], [f"new{rng.randrange(999)}"], [v[at], f"in{rng.randrange(999)}"]])
    return v


def test_similar_classes_against_all_pairs(spark, clashing):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    texts = list(TEXTS) + ["w " * 90, "one two three four", "one two three four five"]
    for size in (60, 150, 400, 900):
        for _ in range(6):
            base = [rng.choice(words) for _ in range(size)]
            texts.append(" ".join(base))
            for changes in (1, 1 + size // 100, 1 + size // 60, size // 20, size // 4):
                texts.append(" ".join(edited(rng, base, changes)))
    hot = [rng.choice(words) for _ in range(200)]
    texts += [" ".join(edited(rng, hot, 1)) for _ in range(60)] + [" ".join(hot).upper()] * 20
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    want = plain_classes(texts)
    got = {}
    for r in simhash.similar_classes(clashing(docs), F.col("doc_id")).collect():
        got.setdefault(r.root, set()).add(r.doc_id)
    root = {i: k for k, own in got.items() for i in own}
    assert len(root) == len(docs)
    apart = sum(len({root[i] for i in own}) - 1 for own in want)
    assert all(any(own <= set(w) for w in want) for own in got.values())  # no link below the similarity
    assert apart <= 0.03 * sum(len(own) - 1 for own in want)  # few links that weren't proposed
    kept = {r.doc_id for r in simhash.keep_one_of_each(clashing(docs)).collect()}
    assert kept == {min(own) for own in got.values()}


def test_runs_propose_their_spanning_trees():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, (3, 2))
    rows = []
    for key, size in ((1, 1), (2, 2), (5, 40), (6, 2), (9, 3)):
        x = base[rng.integers(0, 3, size)] ^ (1 << rng.integers(0, 62, (size, 2)))
        rows += [(key, *map(int, r)) for r in np.unique(x, axis=0)]
    want = set()
    for key in {r[0] for r in rows}:
        own = np.array([r[1:] for r in rows if r[0] == key])
        u, v = simhash._prim(own)
        want |= {(*own[i], *own[j]) for i, j in zip(u, v)}
        far = np.bitwise_count(own[:, None] ^ own[None]).sum(axis=2)
        group = list(range(len(own)))  # the forest's trees are the components at that reach
        for i, j in zip(*np.nonzero(far <= simhash.REACH)):
            group = [group[i] if g == group[j] else g for g in group]
        assert len(u) == len(own) - len(set(group))
    for cut in (1, 3, 7, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part]), pa.array([r[2] for r in part])], ["key", "a", "b"]) for part in (rows[i : i + cut] for i in range(0, len(rows), cut))]
        got = [tuple(r.values()) for b in simhash._propose(iter(batches)) for r in b.to_pylist()]
        assert len(got) == len(set(got)) and {frozenset((r[:2], r[2:])) for r in got} == {frozenset((tuple(map(int, w[:2])), tuple(map(int, w[2:])))) for w in want}
    assert list(simhash._propose(iter([]))) == []


def test_links_that_fingerprints_do_not_propose(spark, monkeypatch):
    """Pairs around 0.8: with nothing proposed at all and with runs as usual, every link is found, and no other."""
    rng = random.Random(33)
    words = [f"w{i}" for i in range(300)]
    common = [rng.choice(words) for _ in range(40)]  # a passage that all texts of a size share
    texts = ["", "one two", "one two three four five six", "a " * 50]
    for size in (8, 30, 120, 500):
        for _ in range(12):
            base = [rng.choice(words) for _ in range(size)] + common[: size // 3]
            texts.append(" ".join(base))
            for changes in (1, max(1, size // 45), max(1, size // 40)):
                texts.append(" ".join(edited(rng, base, changes)))
    rng.shuffle(texts)
    want = {frozenset(own) for own in plain_classes(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def classes():
        got = {}
        for r in simhash.similar_classes(docs, F.col("doc_id")).collect():
            got.setdefault(r.root, set()).add(r.doc_id)
        return {frozenset(own) for own in got.values()}

    assert classes() == want
    monkeypatch.setattr(simhash, "proposed_links", lambda distinct: distinct.selectExpr("a", "b", "a AS c", "b AS d").limit(0))
    assert classes() == want


def test_runs_of_a_shingle_over_batches():
    """Pairs of a run don't depend on where batches end."""
    rng = np.random.default_rng(5)
    rows = sorted((int(rng.integers(0, 12)), i, i // 3, int(rng.integers(40, 60)) << 32 | int(rng.integers(0, 4))) for i in range(60))
    cols = [np.array(c, dtype=np.int64) for c in zip(*rows)]
    want = {(min(a[1], b[1]), max(a[1], b[1])) for a in rows for b in rows if a[0] == b[0] and a[2] != b[2] and min(a[3] >> 32, b[3] >> 32) >= 0.8 * max(a[3] >> 32, b[3] >> 32)
            and min((x[3] >> 32) - (x[3] & 0xFFFFFFFF) for x in (a, b)) * 9 >= 4 * ((a[3] >> 32) + (b[3] >> 32))}
    for step in (1, 7, 60):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + step]) for c in cols], ["key", "id", "root", "at"]) for i in range(0, 60, step)]
        got = [(r["u"], r["v"]) for b in simhash._meet(iter(batches), 0.8) for r in b.to_pylist()]
        assert set(got) == want
    assert list(simhash._meet(iter([]), 0.8)) == []


def test_near_duplicates_let_go_of_shuffle_files_step_by_step(spark, monkeypatch):
    import time

    from kinfold.session import collect_garbage

    live = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    collect_garbage(spark)
    time.sleep(1)
    start, held, write = live(), [], simhash.written

    def watched(df, label):
        time.sleep(0.5)  # Spark's cleaner works beside
        held.append(live() - start)
        return write(df, label)

    monkeypatch.setattr(simhash, "written", watched)
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    docs = spark.createDataFrame([(i, " ".join(words[i % 7 :] + [f"w{i % 3}"] * (i % 4))) for i in range(40)], "doc_id long, text string")
    found = simhash.similar_classes(docs, F.col("doc_id").cast("long").alias("doc_id"))
    assert found.count() == 40
    assert len(held) == 8 and max(held) <= 6  # what the first steps made is gone when the last begin
