import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken
from kinfold.llm import ann, bpe, html


def test_numbers_round_trip():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 1 << k, 200) for k in (1, 7, 8, 14, 15, 21, 22, 28)])
    ends = np.array([0, 3, 3, 900, len(x)])
    cut = bpe.pack_numbers(x, ends)
    assert len(cut) == 5 and np.concatenate([bpe.unpack_numbers(b) for b in cut]).tolist() == x.tolist()
    assert bpe.pack_numbers(x[:0], np.array([0, 0])) == [b"", b""]


def test_words_and_ids_round_trip():
    words = ["a", "é\n", "\0", "😀 x", "a" * 5000]
    assert bpe.unpack_words(bpe.pack_words(words)) == [w.encode() for w in words] and bpe.unpack_words(bpe.pack_words([])) == []
    ids = [[1], [200, 40000], list(range(300))]
    assert [np.frombuffer(b, "<u4").tolist() for b in bpe.unpack_ids(bpe.pack_ids(ids))] == ids


def test_encode_and_decode(spark, clashing):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab  \n\t'sé１　x1!\x1c\x85\r😀") for _ in range(rng.randrange(80))) for _ in range(150)]
    docs = list(enumerate([None, "", "it's <|endoftext|> here", "y" * 20000, "same", "same", *texts])) + [(None, "no id"), (4, "again")]
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    coded = bpe.encode_documents(clashing(docs)).persist()
    digest = lambda t: hashlib.sha256(t).hexdigest()
    want = sorted((str(k), len(ids), digest(" ".join(map(str, ids)).encode()), digest((t or "").encode())) for k, t in docs for ids in [e.encode_ordinary(t or "")])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.decode_documents(coded, digest=True).collect()) == want
    assert sorted(bytes(r.decoded) for r in bpe.decode_documents(coded).collect()) == sorted((t or "").encode() for _, t in docs)
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in bpe.decode_by_join(coded).collect()) == sorted((str(k), (t or "").encode()) for k, t in docs)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(clashing(docs)).collect()) == want
    assert bpe.encode_documents(clashing(docs).limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    mids = rng.normal(size=(12, 16))
    v = mids[rng.integers(0, 12, 1500)] + 0.6 * rng.normal(size=(1500, 16))
    v[200:600] = v[0]  # one vector many times
    rows = [(i, x.tolist(), "mine") for i, x in enumerate(v)]
    rows += [(5000, None, "m"), (5050, [0.0] * 16, "m"), (5100, [float("nan")] * 16, "m"), (5150, [float("inf")] * 16, "m"), (5200, [None] * 16, "m"), (5250, [1.0] * 3, "m"), (None, v[3].tolist(), "m")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 50))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        s = unit @ unit[q]
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and q not in {i for _, i, _ in found}
        assert all(abs(x - s[i]) < 1e-12 for _, i, x in found)
        s[q] = -2
        hits += len(set(np.lexsort((np.arange(1500), -s.round(13)))[:5]) & {i for _, i, _ in found})
    assert hits >= 0.9 * 5 * len(got)
    assert [i for _, i, _ in got[250]] == [0, 200, 201, 202, 203]
    assert ann.nearest(df.limit(0), df).count() == 0
    few = df.filter("vec_id in (0, 1, 50)")
    assert sorted((r.query_id, r.rank) for r in ann.nearest(few, few.filter("vec_id % 50 = 0")).collect()) == [(0, 1), (0, 2), (50, 1), (50, 2)]


PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="site">Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">Accept?</div>%s<aside>Side</aside><section id="comments"><p>Nice!</p></section><form><p>Mail</p></form><script>var x="</p>";</script><footer>&copy; x</footer></body></html>'


def texts(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'mine' AS host", "'mine' AS key", "'mine' AS tree", "'mine' AS text")
    got = html.extract(df).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    return {r.page_id: r.text for r in got}


def test_articles(spark):
    pages = [(i, f"http://h/{i}", PAGE % f"<article><h1>Head &amp; {i}</h1><p>One <b>bold</b>\n  word<br>next<p>Two &lt;3</p><div class='ad'>Buy</div></article>") for i in range(4)]
    pages += [(10, "http://h/x", None), (11, None, ""), (12, "http://h/c", (PAGE % "<article><p>Cut here")[: (PAGE % "<article><p>Cut here").index("Cut here") + 8]), (13, "http://h/t", "<body><article><p>a < b &am</artic")]
    got = texts(spark, pages)
    assert got[2] == "Head & 2\nOne bold word\nnext\nTwo <3"
    assert got[10] == "" and got[11] == "" and got[12] == "Cut here" and got[13] == "a < b &am"
    assert texts(spark, []) == {}


def test_wrappers_without_an_article_element(spark):
    body = "<div class='top'>Our site</div><div class='story'><p>Story %d</p><p>More %d</p></div><div class='end'>All rights</div>"
    pages = [(i, f"http://w/{i}", PAGE % (body % (i, i))) for i in range(5)] + [(9, "http://w/9", PAGE % ("<div class='extra'><p>Odd</p></div>" + body % (9, 9)))]
    got = texts(spark, pages)
    assert got[3] == "Story 3\nMore 3" and got[9] == "Odd\nStory 9\nMore 9"


def random_tree(rng, n, labels="abcd"):
    tree, seen = [(-1, "")], set()
    for _ in range(n):
        node = (rng.randrange(len(tree)), rng.choice(labels))
        if node not in seen:
            seen.add(node)
            tree.append(node)
    return tree


def plain_matching(one, two):
    """Simple tree matching as published: the table over the children of every pair of nodes of one label."""
    kids = [[[k for k in range(1, len(t)) if t[k][0] == n] for n in range(len(t))] for t in (one, two)]

    def match(a, b):
        if one[a][1] != two[b][1]:
            return 0
        xs, ys = kids[0][a], kids[1][b]
        m = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, x in enumerate(xs, 1):
            for j, y in enumerate(ys, 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + match(x, y))
        return 1 + m[-1][-1]

    return match(0, 0)


def test_tree_matching_against_the_published_table():
    rng = random.Random(8)
    for _ in range(400):
        one, two = random_tree(rng, rng.randrange(16)), random_tree(rng, rng.randrange(16))
        m = html.align(one, two)
        pairs = [(x, y) for y, x in enumerate(m) if x is not None]
        assert len(pairs) == plain_matching(one, two)
        for x, y in pairs[1:]:
            assert one[x][1] == two[y][1] and m[two[y][0]] == one[x][0]
            for x2, y2 in pairs[1:]:
                assert one[x][0] != one[x2][0] or (x < x2) == (y < y2)
        assert html.tree_of(html.tree_text(one)) == one


def test_the_verdict_over_pages_decides_inside_an_article(spark):
    page = "<body><article><h1>Head %d</h1><div class='by'>By the desk</div><p>Body %d</p></article></body>"
    many = [(i, f"http://many.org/{i}", page % (i, i)) for i in range(3)]
    two = [(20 + i, f"http://two.org/{i}", page % (7, i)) for i in range(2)]
    got = texts(spark, [*many, (9, "http://one.org/9", page % (9, 9)), *two])
    assert got[21] == "Head 7\nBy the desk\nBody 1"  # an article and its revision
    assert got[1] == "Head 1\nBody 1"  # the same line on all pages is template
    assert got[9] == "Head 9\nBy the desk\nBody 9"  # one page shows no template


def test_what_is_set_aside(spark):
    inner = "<article><header class='article-header'><h1>Title %d</h1></header><p>Text %d</p><footer>Foot %d</footer><section id='comments'><article class='comment'><p>Nice %d</p></article></section></article>"
    frames = ["<html class='no-ad'><body class='with-sidebar'>%s</body></html>", "<body><main class='has-sidebar'>%s</main><aside>Side</aside></body>", "<body><form id='all'><div class='layout has-sidebar'>%s</div></form></body>", "<body><div class='sidebar-right'>%s</div></body>"]
    pages = [(10 * f + i, f"http://f{f}.org/{i}", frame % (inner % (i, i, i, i))) for f, frame in enumerate(frames) for i in range(3)]
    got = texts(spark, pages)
    for key, text in got.items():
        assert text == f"Title {key % 10}\nText {key % 10}", key


def test_depth_has_no_bound(spark):
    deep = lambda i: "<body>" + "<div>" * 3000 + f"<article><p>Deep {i}</p></article>" + "</div>" * 3000 + "<div><p>Else %d</p></div>" % (i * 7)
    got = texts(spark, [(1, "http://d.org/1", deep(1)), (2, "http://e.org/1", "word " * 40000)])
    assert got[1] == "Deep 1" and got[2] == ("word " * 40000).strip()


def test_pages_of_the_tables(spark):
    """Against a plain recount: the trees of a host's pages are alike there, so paths name the slots."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    said, hosts = {}, {}
    for r in rows:
        host = r.url.split("://", 1)[1].split("/")[0].lower()
        tree, own = html.blocks(r.html)
        aside, inside = html.parts(tree)
        path = [""]
        for up, label in tree[1:]:
            path.append(f"{path[up]}/{label}")
        kept = [(path[n], t, inside[n]) for n, t in own if not aside[n]]
        said[r.page_id] = host, kept
        if kept:
            hosts.setdefault(host, {})[tuple(t for _, t, _ in kept)] = kept
    got = {r.page_id: r.text for r in html.op10_wrapper_induction(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == set(said)
    for key, (host, kept) in said.items():
        pages = hosts.get(host, {}).values()
        good = []
        for path, text, inside in kept:
            having = [{t for q, t, _ in page if q == path} for page in pages]
            varied = len(set().union(*having)) > 1 or sum(map(bool, having)) == 1
            if (varied or len(pages) == 2 and inside if len(pages) > 1 else inside or not any(x for _, _, x in kept)):
                good.append(text)
        assert got[key] == "\n".join(good)


def test_rows_that_repeat_ties_and_null_urls(spark):
    two = "<body><div class='%s'><p>A %d</p></div></body>"  # either tree is as frequent as the other
    pages = [(1, "http://t.org/1", two % ("x", 1)), (1, "http://t.org/1", two % ("x", 1)), (2, "http://t.org/2", two % ("y", 2)), (2, "http://t.org/2", two % ("y", 2)), (3, None, two % ("x", 3)), (3, None, None), (None, "http://t.org/4", "")]
    got = sorted((str(r.page_id), r.text) for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect())
    assert got == [("1", "A 1"), ("1", "A 1"), ("2", "A 2"), ("2", "A 2"), ("3", ""), ("3", "A 3"), ("None", "")]


def test_workers_need_no_copy_of_the_package(tmp_path):
    """What runs on executors is pickled whole: a Python without the package can unpickle and run it."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f").write_bytes(cloudpickle.dumps((html.blocks, html.parts, html.names, ann.centres, bpe.pack_words)))
    code = "import pickle, sys; b, p, n, c, w = pickle.load(open('f', 'rb')); t, o = b('<body><p class=x>Hi</p>'); print(o, p(t)[0], n(t, t), 'kinfold' in sys.modules)"
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
    assert ran.stdout.strip() == "[(2, 'Hi')] [False, False, False] [0, 1, 2] False", ran.stderr


def test_copies_of_one_page_are_one_page(spark):
    page, other = ("<body><h1>%s</h1><div class='a'><p>%s</p></div><footer>f</footer></body>" % x for x in (("Head", "Body one"), ("Head", "Body two")))
    one = [(1, "http://one.org/1", page)]
    copies = [(k, f"http://copies.org/{k}", page) for k in (2, 3, 4)]
    varied = [(5, "http://varied.org/5", page), (6, "http://varied.org/6", page), (7, "http://varied.org/7", other)]
    got = texts(spark, one + copies + varied)
    assert got[1] == got[2] == got[3] == got[4] == "Head\nBody one"
    assert got[5] == got[6] == "Body one" and got[7] == "Body two"


def test_recall_on_the_embeddings(spark):
    """At least 0.9 of the true nearest, and exact scores, against brute force over the whole table."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in rows])
    v = np.array([r.embedding for r in rows], dtype=np.float64)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in ann.op3_adaptive_scan(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    asked = np.flatnonzero(ids % 50 == 0)
    assert set(got) == set(ids[asked].tolist())
    hits = 0
    for i in asked:
        s = unit @ unit[i]
        s[i] = -2
        at = dict(zip(ids.tolist(), s.tolist()))
        found = got[int(ids[i])]
        assert sorted(found) == [1, 2, 3, 4, 5] and all(abs(x - at[k]) < 1e-12 for k, x in found.values())
        hits += len({k for k, _ in found.values()} & set(ids[np.lexsort((ids, -s.round(13)))[:5]].tolist()))
    assert hits >= 0.9 * 5 * len(asked)


def test_scan_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:40]
    ids = np.arange(1500)
    a, b, dist = ann.scan(x, ids, q, np.full(40, np.inf), 6)
    true = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.allclose(dist, true[a, b])
    hits = sum(len(set(b[a == i]) & set(np.argsort(true[i])[:6])) for i in range(40))
    assert hits >= 0.97 * 6 * 40
    a2, b2, _ = ann.scan(x, ids, q, np.zeros(40), 6)  # a bound of nothing leaves each query itself alone
    assert (a2 == b2).all() and len(a2) == 40


def test_vectors_of_unlike_length_each_find_their_own(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(0, 120, 10)] + [(i, [float(i), 1.0, 2.0]) for i in range(5, 125, 10)] + [(50, [3.0, 3.0, 3.0]), (100, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 50 = 0"), top=3).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) >= {0, 50, 100} and all(k % 10 == 0 for k in got[0])
