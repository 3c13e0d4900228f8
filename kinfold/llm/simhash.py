"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits link at two or fewer differing bits. Cut into two segments of 32 bits, one of
them differs by at most one bit; so two linked fingerprints share a variant in which one bit of that segment is a
wildcard. Each distinct fingerprint is indexed under its 64 variants, equal variants meet in one sorted run, and
links are verified there. Copies share a fingerprint and are one row from the start, and a run yields a spanning
forest of its verified links, so neither grows with the square of a group.

A run of over ``RUN`` distinct fingerprints isn't compared pair by pair: its members agree in one half but for a bit, so the
other half is cut into three parts, of which two linked members share one, and members that share a part are
searched breadth first, each against those not yet reached. A tight group is reached in a few steps. A run is
8 bytes for each distinct fingerprint in it.

``similar_classes`` finds near copies by what they share of their five-word shingles. There the method only proposes: fingerprints of 126
bits over two-word shingles (of which a change of one word spoils two, not five) are cut into six segments of 21 bits, one-wildcard variants
meet in runs, and a run proposes the links of its minimum spanning tree by differing bits. So a group's closest pairs are proposed, no
more of them than it has members. The five-word shingles of the proposed pairs then decide, exactly.

What was not proposed is found by an exact similarity join. All shingles have one order, those that many texts share last; a text's prefix is so many of
its first shingles that another as similar must have one of them in its own prefix. Texts of one class by then aren't paired again, pairs whose sizes or
places rule the similarity out are dropped, and the full sets of the others decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import collect_garbage
from .common import discard, table, written
from .components import connected_components

WORDS, SEED, BITS = 3, 42, 2
RUN = 512

#: Of ``similar_classes``: words of a deciding shingle and their least similarity; words of a proposing one, segments, their bits, and the most differing bits of all.
SHINGLE, SIMILARITY = 5, 0.8
PAIR_WORDS, SEGMENTS, WIDTH, REACH = 2, 6, 21, 26
TREE = 4096  # members of a run whose tree is taken at once


def _shingle_hashes(text: bytes) -> list[int]:
    words = text.lower().split()  # of bytes: A-Z alone are lowered, space and \x09-\x0D alone divide
    h = xxhash.xxh64_intdigest
    if len(words) < WORDS:
        return [h(b" ".join(words), SEED)] if words else []
    join = b" ".join
    return [h(join(t), SEED) for t in zip(words, words[1:], words[2:])]


def _fold(own: list[int]) -> int:
    """The fingerprint of a list of hashes: a bit is set if it is in over half of them; zero of none."""
    if not own:
        return 0
    a = np.array(own, dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(a), 8192):
        counts += np.unpackbits(a[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(a)).view(np.uint64)[0])


def fingerprint(text: bytes) -> int:
    """Of one text; its hashes are folded before the next text's are made."""
    return _fold(_shingle_hashes(text))


def fingerprints(docs: DataFrame, *beside: Column) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and the columns ``beside``. A null text has no words and so the fingerprint zero."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *beside)
    names = ["doc_id", "fp", *rows.columns[2:]]
    schema = ", ".join(["doc_id long", "fp long", *[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[2:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fp = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under its one-wildcard segment variants: key = segment, wildcard, other 31 bits."""
    bit = np.arange(32, dtype=np.uint64)
    for whole in batches:
        for at in range(0, whole.num_rows, 8192):
            fp = whole.column(0).slice(at, 8192).to_numpy().view(np.uint64)
            keys = []
            for s in (0, 1):
                segment = (fp >> np.uint64(32 * s)) & np.uint64(0xFFFFFFFF)
                masked = segment[:, None] & ~(np.uint64(1) << bit)[None, :]
                keys.append(masked | (bit << np.uint64(32))[None, :] | np.uint64(s << 37))
            key = np.concatenate(keys, axis=1).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(fp, 64).view(np.int64))], ["key", "fp"])


def _links(fp: np.ndarray, key: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) of one run: a forest whose trees are the run's components at ``BITS`` or fewer differing bits."""
    x = fp.view(np.uint64)
    if len(x) == 2:
        near = np.bitwise_count(x[0] ^ x[1]) <= BITS
        return (fp[:1], fp[1:]) if near else (fp[:0], fp[:0])
    if len(x) <= longest:
        label = np.arange(len(x))
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= BITS
        while True:  # the smallest index that each one reaches
            lower = np.where(near, label[None, :], len(x)).min(axis=1)
            lower = lower[lower]
            if (lower == label).all():
                break
            label = lower
        own = label != np.arange(len(x))
        return fp[own], fp[label[own]]
    free = (x >> np.uint64(0 if key >> 37 & 1 else 32)) & np.uint64(0xFFFFFFFF)  # the half that the key doesn't hold
    out = [_searched(fp, (free >> np.uint64(shift)) & np.uint64((1 << width) - 1)) for shift, width in ((0, 11), (11, 11), (22, 10))]
    return np.concatenate([u for u, _ in out]), np.concatenate([v for _, v in out])


def _searched(fp: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Breadth first, among members of equal ``part``: each reached one with the one it is reached from."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    us, vs = [fp[:0]], [fp[:0]]
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
        rest = fp[order[a:b]]
        while len(rest) > 1:
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                at = queue.pop()
                near = np.bitwise_count((rest ^ at).view(np.uint64)) <= BITS
                if near.any():
                    found, rest = rest[near], rest[~near]
                    us.append(found), vs.append(np.full(len(found), at))
                    queue.extend(found)
    return np.concatenate(us), np.concatenate(vs)


def _verify(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key: verified links (u, v) of each run, a forest. Holds the run that goes over a batch's end."""
    held_key, held = None, []

    def batch_of(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        u, v = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        found = []
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        many = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(key)))
        for a, b in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
            if a == 0 and held_key is not None:
                if key[0] != held_key:
                    found.append(_links(np.concatenate(held), int(held_key), longest))
                    held = []
                run = held
                run.append(np.array(fp[:b]))
            else:
                run = [np.array(fp[a:b])]
            if b == len(key):  # the run may go on
                held_key, held = key[-1], run
            elif sum(map(len, run)) > 1:
                found.append(_links(np.concatenate(run), int(key[a]), longest))
        if found:
            yield batch_of(found)
    if held_key is not None and sum(map(len, held)) > 1:
        yield batch_of([_links(np.concatenate(held), int(held_key), longest)])


def near_links(distinct: DataFrame, longest: int = RUN) -> DataFrame:
    """distinct: fp, no repeats. Links (u, v) whose components are those of all pairs within two bits."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Few bytes that become 64 times as many: so many tasks, whatever their size. By a hash, as a shuffle by the key itself would be taken for the one below it and merged.
    spread = distinct.select("fp").repartition(parts, F.xxhash64("fp"))
    sorted_ = spread.mapInArrow(_variants, "key long, fp long").repartition(parts, "key").sortWithinPartitions("key", "fp")
    found, _ = written(sorted_.mapInArrow(partial(_verify, longest=longest), "u long, v long"), "found")
    return found


def _placed(prints: DataFrame, first: Column) -> DataFrame:
    """fp, first, root: each fingerprint's component and the aggregate ``first`` of its rows."""
    distinct = prints.groupBy("fp").agg(first.alias("first"))
    roots = connected_components(near_links(distinct.select("fp")))
    return distinct.join(roots, distinct["fp"] == roots["id"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``: the smallest doc_id in the row's component.

    Null and wordless texts have the fingerprint zero and link like any other. Rows without doc_id take part; a
    component of such rows alone has a null component_id. Repeated rows are repeated in the
    result. An empty table gives an empty result."""
    prints, _ = written(fingerprints(docs), "prints")
    placed = _placed(prints, F.min("doc_id"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = placed.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def op4_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shingles(words: list[bytes], n: int) -> set[bytes]:
    """Distinct runs of n words; of fewer words the whole sequence, of none nothing."""
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def _wide_fingerprint(words: list[bytes]) -> tuple[int, int]:
    """The first 126 bits of a 128-bit fingerprint over the distinct shingles of ``PAIR_WORDS`` words, 63 in each of two numbers."""
    digests = [xxhash.xxh3_128_digest(x) for x in _shingles(words, PAIR_WORDS)]
    if not digests:
        return 0, 0
    counts = np.zeros(128, dtype=np.int64)
    for at in range(0, len(digests), 4096):
        part = np.frombuffer(b"".join(digests[at : at + 4096]), dtype=np.uint8).reshape(-1, 16)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = 2 * counts > len(digests)
    both = (bits[:126].reshape(2, 63) * (1 << np.arange(63, dtype=np.int64))).sum(axis=1)
    return int(both[0]), int(both[1])


def _wide_prints(docs: DataFrame, *beside: Column) -> DataFrame:
    """a, b (the fingerprint), content (a digest of the text's words) and the columns ``beside`` of every row."""
    rows = docs.select(F.col("text").cast("string").alias("__text"), *beside)
    names = ["a", "b", "content", *rows.columns[1:]]
    schema = ", ".join(["a long, b long, content binary", *[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(0).cast(pa.binary()):
                words = (t.as_py() or b"").lower().split()
                found.append((*_wide_fingerprint(words), xxhash.xxh3_128_digest(b" ".join(words))))
            a, b, content = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(content, pa.binary()), *batch.columns[1:]], names)

    return rows.mapInArrow(run, schema)


def _wide_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint (a, b) under its one-wildcard segment variants."""
    bit = np.arange(WIDTH, dtype=np.int64)
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            a, b = (whole.column(i).slice(at, 4096).to_numpy() for i in (0, 1))
            keys = []
            for s in range(SEGMENTS):
                part = ((a if s < 3 else b) >> (WIDTH * (s % 3))) & ((1 << WIDTH) - 1)
                keys.append((part[:, None] & ~(1 << bit)[None, :]) | (bit << WIDTH)[None, :] | s << 26)
            key = np.concatenate(keys, axis=1).reshape(-1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(a, SEGMENTS * WIDTH)), pa.array(np.repeat(b, SEGMENTS * WIDTH))], ["key", "a", "b"])


def _tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``x`` (a, b): the minimum spanning forest by differing bits, ``REACH`` at most. Of equal distances the first row's counts."""
    m = len(x)
    if m > TREE:  # parts that agree in one more segment, cut by each of the others in turn; what stays long is taken as it is
        us, vs = [], []
        for s in range(SEGMENTS):
            part = (x[:, s // 3] >> (WIDTH * (s % 3))) & ((1 << WIDTH) - 1)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            if len(cuts):
                for own in np.split(order, cuts):
                    if len(own) > 1:
                        u, v = _prim(x[own])
                        us.append(own[u]), vs.append(own[v])
        return (np.concatenate(us), np.concatenate(vs)) if us else _prim(x)
    return _prim(x)


def _prim(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rest = np.arange(1, len(x))
    away, near = np.bitwise_count(x[1:] ^ x[0]).sum(axis=1, dtype=np.int64), np.zeros(len(x) - 1, dtype=np.int64)
    us, vs = [], []
    while len(rest):
        i = int(away.argmin())
        n = int(rest[i])
        if away[i] <= REACH:
            us.append(int(near[i])), vs.append(n)
        rest, away, near = np.delete(rest, i), np.delete(away, i), np.delete(near, i)
        own = np.bitwise_count(x[rest] ^ x[n]).sum(axis=1, dtype=np.int64)
        closer = own < away
        away[closer], near[closer] = own[closer], n
    return np.array(us, dtype=np.int64), np.array(vs, dtype=np.int64)


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, a, b) sorted by all three: the proposed links (a, b, c, d) of each run. Holds the run that goes over a batch's end."""
    held_key, held = None, []

    def found(runs: list[np.ndarray], two: np.ndarray) -> pa.RecordBatch:
        links = [two]
        for x in runs:
            u, v = _tree(x)
            links.append(np.concatenate([x[u], x[v]], axis=1))
        out = np.concatenate(links)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, i])) for i in range(4)], ["a", "b", "c", "d"])

    none = np.empty((0, 4), dtype=np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        key, x = batch.column(0).to_numpy(), np.stack([batch.column(i).to_numpy() for i in (1, 2)], axis=1)
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        edge = (starts == 0) | (ends == len(key))
        two = starts[(ends - starts == 2) & ~edge]  # most runs: taken together
        near = two[np.bitwise_count(x[two] ^ x[two + 1]).sum(axis=1) <= REACH]
        runs = []
        for i, j in zip(starts[edge | (ends - starts > 2)].tolist(), ends[edge | (ends - starts > 2)].tolist(), strict=True):
            if i == 0 and held_key is not None and key[0] != held_key:
                runs.append(np.concatenate(held))
                held = []
            run = [*(held if i == 0 else []), x[i:j]]
            if j == len(key):
                held_key, held = key[-1], run
            else:
                runs.append(np.concatenate(run))
        yield found([r for r in runs if len(r) > 1], np.concatenate([x[near], x[near + 1]], axis=1))
    if held and sum(map(len, held)) > 1:
        yield found([np.concatenate(held)], none)


def proposed_links(distinct: DataFrame) -> DataFrame:
    """distinct: a, b, no repeats. Proposed links (a, b, c, d), each once."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = distinct.select("a", "b").repartition(parts, F.xxhash64("a", "b"))
    runs = spread.mapInArrow(_wide_variants, "key int, a long, b long").repartition(parts, "key").sortWithinPartitions("key", "a", "b")
    return runs.mapInArrow(_propose, "a long, b long, c long, d long").distinct()


def _settled(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``written``; the shuffle files that made the table go before the next step makes its own, as those of all steps together are several times the input."""
    out = written(df, label)
    del df
    collect_garbage(out[0].sparkSession)
    return out


def _shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """content, text to content, shingles (array of hashes of the distinct shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh64_intdigest
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [np.fromiter((h(x) for x in _shingles((t.as_py() or b"").lower().split(), words)), dtype=np.uint64).view(np.int64) for t in batch.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["content", "shingles"])

    return texts.select("content", F.col("text").cast("string")).mapInArrow(run, "content binary, shingles array<long>")


def _least_common(n: np.ndarray | int, similarity: float):
    """Of sets of ``n`` shingles together: how many both must have."""
    return np.ceil(similarity / (1 + similarity) * n - 1e-9)


def _prefixes(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], words: int, similarity: float) -> DataFrame:
    """content, size, prefix: how many shingles a text has and, in an order that all texts share, so many of the first that one as similar has one of them among
    its own. common: hashes of shingles, sorted, and their numbers, which come last in the order; it bears on the length of runs alone."""
    known, times = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh64_intdigest
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                contents, sizes, firsts = [], [], []
                for t in whole.column(0).slice(at, 256).cast(pa.binary()):
                    own = (t.as_py() or b"").lower().split()
                    x = np.fromiter((h(s) for s in _shingles(own, words)), dtype=np.uint64).view(np.int64)
                    weight = np.zeros(len(x), dtype=np.int64)
                    if len(known):
                        place = np.minimum(np.searchsorted(known, x), len(known) - 1)
                        weight = np.where(known[place] == x, times[place], 0)
                    most = len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1 if len(x) else 0
                    contents.append(xxhash.xxh3_128_digest(b" ".join(own))), sizes.append(len(x)), firsts.append(x[np.lexsort((x, weight))[:most]])
                yield pa.RecordBatch.from_arrays([pa.array(contents, pa.binary()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))], ["content", "size", "prefix"])

    return texts.select(F.col("text").cast("string")).mapInArrow(run, "content binary, size long, prefix array<long>")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, root, size, prefix): each shingle of the prefix as a row (key, id, root, at), where ``at`` is the size and behind it the place in 32 bits."""
    for whole in batches:
        for start in range(0, whole.num_rows, 512):
            batch = whole.slice(start, 512)
            key = batch.column(3).flatten().to_numpy()
            n = batch.column(3).value_lengths().fill_null(0).to_numpy()
            place = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
            ids, roots, sizes = (np.repeat(batch.column(i).to_numpy(), n) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, ids, roots, sizes << 32 | place)], ["key", "id", "root", "at"])


def _met(rows: np.ndarray, similarity: float) -> np.ndarray:
    """Rows (key, id, root, at) of whole runs: pairs of ids of a run and of different roots that can be as similar, if this shingle is the first in order that both have."""
    key, own, root, size = (np.ascontiguousarray(rows[:, i]) for i in range(4))
    size, rest = size >> 32, (size >> 32) - (size & 0xFFFFFFFF)
    out, i, away = [np.empty((0, 2), dtype=np.int64)], np.arange(len(key) - 1), 1
    while len(i := i[key[i] == key[i + away]]):
        j = i + away
        fits = (root[i] != root[j]) & (np.minimum(rest[i], rest[j]) >= _least_common(size[i] + size[j], similarity)) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9)
        u, v = own[i[fits]], own[j[fits]]
        out.append(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1))
        away += 1
        i = i[i + away < len(key)]
    return np.unique(np.concatenate(out), axis=0)


def _meet(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, root, at) sorted by key: the pairs (u, v) of each run. Holds the run that goes over a batch's end."""

    def found(rows: list[np.ndarray]) -> pa.RecordBatch:
        pairs = _met(np.concatenate(rows), similarity)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], ["u", "v"])

    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        if last or (held and held[0][0, 0] != rows[0, 0]):
            yield found([*held, rows[:last]])
            held = []
        held.append(rows[last:])
    if held:
        yield found(held)


SAMPLE, LISTED = 50_000, 500_000  # texts that the order of shingles is taken from at most, an eighth of all in small tables, and how many it lists; every order finds all pairs


def _common_shingles(docs: DataFrame, mark: Column, total: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that texts of a sample share, sorted, and their numbers."""
    every = max(1, min(8, total // 2000), -(-total // SAMPLE))
    few = docs.select(mark.alias("content"), "text").filter(F.pmod(F.xxhash64("content"), F.lit(every)) == 0).select(F.col("content").cast("binary"), "text")
    each = _shingle_sets(few, words).dropDuplicates(["content"]).select(F.explode("shingles").alias("h"))
    rows = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "h").limit(LISTED).toPandas()
    h, n = rows["h"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def missed_pairs(docs: DataFrame, roots: DataFrame, common: tuple[np.ndarray, np.ndarray], words: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """u, v: pairs of different roots among which are all of at least ``similarity``. roots: id, root; contents without one are their own."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = _prefixes(docs, common, words, similarity).groupBy(F.xxhash64("content").alias("id")).agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    placed = each.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"), "size", "prefix")
    runs = placed.mapInArrow(_spread, "key long, id long, root long, at long").repartition(parts, "key").sortWithinPartitions("key")
    return runs.mapInArrow(partial(_meet, similarity=similarity), "u long, v long").distinct()


def _alike(docs: DataFrame, mark: Column, contents: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v: hashes of contents) that have the similarity, by all their shingles; a table."""
    asked = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    marks = contents.withColumn("id", F.xxhash64("content")).join(asked, "id", "left_semi").select("content", F.col("mark").alias("__mark"))
    texts = docs.select("text", mark.alias("__mark")).join(marks, "__mark").dropDuplicates(["content"])
    sets, shingled = _settled(_shingle_sets(texts, words), "shingles")
    of = lambda x: sets.select(F.xxhash64("content").alias(x), F.col("shingles").alias(f"s{x}"))
    common = F.size(F.array_intersect("su", "sv"))
    alike = pairs.join(of("u"), "u").join(of("v"), "v").filter(common >= similarity * (F.size("su") + F.size("sv") - common) - 1e-9)
    out, _ = _settled(alike.select("u", "v"), "alike")
    discard(docs.sparkSession, shingled)
    return out


def similar_classes(docs: DataFrame, *beside: Column, words: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """content, root and the columns ``beside`` of every row of ``docs``. Rows of one root reach each other by links of at least ``similarity``
    (common by all distinct shingles of ``words`` words); a root is the content of one of them in a hashed form.

    A text is its words, A-Z in lower case; texts of the same words are one from the start, null and wordless texts among them. Links are verified
    exactly. Most are proposed by fingerprints; then all pairs of different classes that can have the similarity are found by the prefixes of their shingles, so that none is missed."""
    mark = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    prints, _ = _settled(_wide_prints(docs, mark.alias("__mark"), *beside), "wide")
    contents = prints.groupBy("a", "b", "content").agg(F.min("__mark").alias("mark"))
    first = contents.groupBy("a", "b").agg(F.min("content").alias("first"))
    links, proposed = _settled(proposed_links(first), "proposed")
    second = first.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("first").alias("v"))
    between = links.join(first, ["a", "b"]).join(second, ["c", "d"]).select(F.xxhash64("first").alias("u"), F.xxhash64("v").alias("v"))
    within = contents.join(first, ["a", "b"]).filter("content <> first").select(F.xxhash64("first").alias("u"), F.xxhash64("content").alias("v"))
    pairs, paired = _settled(between.unionByName(within), "pairs")
    discard(docs.sparkSession, proposed)
    near = connected_components(_alike(docs, mark, contents, pairs, words, similarity))
    others, met = _settled(missed_pairs(docs, near, _common_shingles(docs, mark, prints.count(), words), words, similarity), "met")
    of = lambda x: near.select(F.col("id").alias(x), F.col("root").alias(f"r{x}"))
    late = _alike(docs, mark, contents, others, words, similarity).join(of("u"), "u", "left").join(of("v"), "v", "left")
    joined = connected_components(late.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))).select(F.col("id").alias("__near"), F.col("root").alias("__far"))
    for path in (paired, met):  # the components are tables of their own
        discard(docs.sparkSession, path)
    rest = [c for c in prints.columns if c not in ("a", "b", "content", "__mark")]
    own = prints.withColumn("__id", F.xxhash64("content"))
    placed = own.join(near.withColumnRenamed("root", "__root"), own["__id"] == near["id"], "left").withColumn("__near", F.coalesce("__root", "__id"))
    return placed.join(joined, "__near", "left").select("content", F.coalesce("__far", "__near").alias("root"), *rest)


def keep_one_of_each(docs: DataFrame, words: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class of ``similar_classes`` one row, the one with the smallest doc_id. Of rows of
    a class that repeat this id, or of those of a class without ids, the one with the smallest hash of its text stays, and of those that
    repeat that too the first by their other columns. Rows of different classes don't touch each other, whatever their ids. Null
    texts count as empty; an empty table gives an empty result; other columns stay as they are, whatever their names."""
    from pyspark.sql import Window

    mark = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    placed = similar_classes(docs, F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"), words=words, similarity=similarity)
    keep = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.mark").alias("__own"))
    # Equal ids and texts are of one class, so each pair of them in ``keep`` stands for one class.
    marked = docs.withColumn("__mark", mark)
    stays = marked.join(keep, marked["doc_id"].eqNullSafe(keep["__id"]) & (F.col("__mark") == F.col("__own")), "left_semi")
    first = Window.partitionBy("doc_id", "__mark").orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")] or ["doc_id"])
    return stays.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select(*docs.columns)
