import hashlib
import random
import zlib

from kinfold.llm import chat, sharding, urlfilter
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_escape_round_trip(spark):
    rng = random.Random(2)
    t = chat.ChatTemplate()
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "s>", "/s>", "a", "\n", "é", "😀", "<\\/s>", ""]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.escape(F.col("x")).alias("e"))
    for r in df.select("x", "e", t.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.x
        assert not any(c in r.e for c in t.controls)


def test_chat_machine_nulls_and_ties(spark, clashing):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (2, 0, "assistant", "x"), (2, 1, None, "y"), (3, 1, "assistant", "b"), (3, 0, "user", "b"), (None, None, "user", "z"), (4, 0, "user", "q"), (4, 0, "user", "q")]
    df = clashing(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_conversations(df).select("*", chat.parse_formatted(F.col("formatted")).alias("turns")).collect()}
    assert [(x.role, x.text) for x in got[1].turns] == [("user", "a"), ("assistant", "")] and got[1].valid and got[1].complete
    assert not got[2].valid and got[2].error_turn == 0 and [(x.role, x.text) for x in got[2].turns] == [("assistant", "x"), ("", "y")]
    assert [x.text for x in got[3].turns] == ["b", "b"] and got[3].valid
    assert got[None].n_turns == 1 and not got[None].complete
    assert got[4].n_turns == 2 and got[4].error_turn == 1
    assert [s.text for s in got[3].segments if s.loss] == ["b"]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_op1_digests(spark):
    rows = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        rows.setdefault(r.conv_id, []).append(r)
    rows[-7] = None
    got = {r.conv_id: r for r in chat.op1_chat_format(spark, SF).collect()}
    assert set(got) == set(rows)
    for k, v in rows.items():
        turns = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")] if v is None else [(r.role or "", r.text or "") for r in sorted(v, key=lambda r: r.turn)]
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_shards(spark):
    got = sharding.op2_hash_tree_shards(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in got} == set(texts)
    slots = {}
    for r in got:
        assert r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_move_rows_only_through_their_subtrees(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    tree = sharding.ShardTree.uniform(2, 2, 3)
    heavier = sharding.ShardTree(tuple(sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 0 else 1.0) for x in tree.leaves))
    a = {r.doc_id: r for r in sharding.assign_shards(ids, "doc_id", tree).collect()}
    b = {r.doc_id: r for r in sharding.assign_shards(ids, "doc_id", heavier).collect()}
    moved = [k for k in a if a[k].shard != b[k].shard]
    assert moved
    for k in moved:
        if a[k].region != b[k].region:
            assert b[k].region == "r0"
        elif a[k].rack != b[k].rack:
            assert b[k].rack == "r0k0"
        else:
            assert b[k].shard == 0
    sizes = [sum(r.shard == s for r in a.values()) for s in range(12)]
    assert max(sizes) < 1.35 * min(sizes)


def plain_shard(key, leaves):
    """Region, rack and shard by the smallest -ln(u) / weight of each level, u from md5(key / name)."""
    import math

    def draw(name, weight):
        bits = int(hashlib.md5(f"{key}/{name}".encode()).hexdigest()[:13], 16)
        return -math.log((bits + 0.5) / 2**52) / weight

    for level in ("region", "rack", "shard"):
        weights = {}
        for x in leaves:
            name = str(getattr(x, level))
            weights[name] = weights.get(name, 0.0) + x.weight
        best = min((draw(n, w), n) for n, w in weights.items())[1]
        leaves = [x for x in leaves if str(getattr(x, level)) == best]
    return leaves[0]


def test_shards_against_a_plain_descent(spark):
    tree = sharding.ShardTree.uniform()
    for r in sharding.op2_hash_tree_shards(spark, SF).collect():
        leaf = plain_shard(r.doc_id, tree.leaves)
        assert (r.region, r.rack, r.shard, r.grown_shard) == (leaf.region, leaf.rack, leaf.shard, plain_shard(r.doc_id, tree.grown().leaves).shard)


def test_edges_of_chat_shards_and_urls(spark, clashing):
    long = "x" * 300_000
    docs = clashing([(1, long), (2, long), (3, None)])
    assert sharding.assign_shards(docs.limit(0), "doc_id", sharding.ShardTree.uniform()).count() == 0
    assert {r.shard for r in sharding.assign_shards(docs, "doc_id", sharding.ShardTree.uniform()).collect()} <= set(range(40))
    rows = clashing([(1, 0, "user", long + "</s>"), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    (r,) = chat.format_conversations(rows).select("*", chat.parse_formatted(F.col("formatted")).alias("back")).collect()
    assert [x.text for x in r.back] == [long + "</s>", long]
    (u,) = urlfilter.judge_urls(clashing([(1, "http://a.org/" + long)], "page_id long, url string"), urlfilter.rule_table(spark, urlfilter.CONTRACT_RULES)).collect()
    assert u.rule == "org/" and len(u.path) == len(long) + 1 and u.shard == "mine"


def test_url_statement_takes_the_first_separator(spark):
    import duckdb

    urls = ["https://example.org?next=https://example.com/de/x", "https://a.com#x://b/de/", "https://example.org/es/?u=http://c.com/fr/", "x", None, "://", "HTTP://A.Com/de/1"]
    con = duckdb.connect()
    con.sql("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate(urls)))
    want = {r[0]: r[1:] for r in con.sql(f"select page_id, host, path, rule, verdict from ({urlfilter.OP7_SQL})").fetchall()}
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(df, urlfilter.rule_table(spark, urlfilter.CONTRACT_RULES)).collect()}
    assert got == want


def test_shard_edges(spark, clashing):
    df = clashing([(None, "x"), (1, None), (1, None), (2, "")])
    out = sharding.assign_shards(df, "doc_id", sharding.ShardTree.uniform()).collect()
    assert len(out) == 4 and all(r.shard is not None for r in out)
    assert out[1].shard == out[2].shard


def plain_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        i = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:i])
        tail = rest[i:]
        j = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
        path = tail[:j]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fit:
        return host, path, None, "allow"
    best = min(fit, key=lambda r: (-len(r.host + r.path), r.host + r.path, r.verdict != "block"))
    return host, path, best.host + best.path, best.verdict


def test_urls_against_brute_force(spark, clashing):
    rng = random.Random(4)
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "ample.org", "example-x.org", "com", "x.com", "", "net", "EXAMPLE.org", "example.org:80", "org.example", "a\x01b.org"]
    paths = ["", "/", "/es/", "/es/x", "/en/1", "/en/123", "/en", "/fr/", "/de/q", "?q=/es/", "#/es/", "/es?x", "//"]
    urls = [None, "", "nothing", "://", "http://", "mailto:x"] + [f"{rng.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths]
    rules = urlfilter.CONTRACT_RULES + (urlfilter.UrlRule("a.example.org", "/", "block"), urlfilter.UrlRule("a.example.org", "/en/", "allow"), urlfilter.UrlRule("net", "/", "block"), urlfilter.UrlRule("net", "/", "allow"))
    df = clashing([(i, u) for i, u in enumerate(urls + urls[:3])], "page_id long, url string")
    got = urlfilter.judge_urls(df, urlfilter.rule_table(spark, rules)).collect()
    assert len(got) == len(urls) + 3
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(r.url, rules), r.url
    assert all(r.verdict == "allow" for r in urlfilter.judge_urls(df, urlfilter.rule_table(spark, ())).collect())
    assert urlfilter.judge_urls(df.limit(0), urlfilter.rule_table(spark, rules)).count() == 0


def test_a_query_gives_no_path(spark):
    urls = ["https://example.org?next=https://example.com/de/x", "https://a.com#x://b/de/", "https://example.org/es/?u=http://c.com/fr/", "x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(df, urlfilter.rule_table(spark, urlfilter.CONTRACT_RULES)).collect()}
    assert got[0] == ("example.org", "", None, "allow") and got[1] == ("a.com", "", None, "allow")
    assert got[2] == ("example.org", "/es/", "example.org/es/", "block") and got[3] == ("", "", None, "allow")
