"""Best-fit packing by a configuration linear program over the length histogram.

Documents become pieces of at most ``capacity`` tokens. The driver sees the histogram of piece lengths alone (at
most ``capacity`` rows). A configuration is a multiset of length classes that fills one sequence; the program asks for the least
sum of multiplicities x that covers every class's pieces. It is solved by multiplicative weights: in each round a knapsack dynamic program
finds the configuration of the highest price, which gets an equal share of the mass, and the price of a class falls by a factor for each piece
of it that is covered ahead of the others. The prices' average is the dual solution, which bounds the number of sequences from below.

Rounding takes x down to whole numbers and puts lengths in place of classes, the last two of a sequence so that they fill it exactly if
any two left do; the program is solved again for what is left, a few times, and best fit decreasing places the remainder. The plan that
comes back says which ranks of which length go where; it has at most (configurations x distinct lengths in each) rows, whatever the corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gapless, table, written
from .tokens import ChunkEncoder, rank_encoder

Config = tuple[tuple[int, int], ...]  # (length, how many), longest first
CLASSES = 64  # length classes of a full sequence; up to twice that capacity every length is a class of its own
ROUNDS = 1500  # of the multiplicative weights, at most
RATE = 10.0  # by how much a price falls (in the logarithm) for a class that is covered as often again
SOLVES = 8  # how often the program is solved, at most; best fit takes what is left then
LOOSE = 2  # the last of them, whose sequences needn't be full to the end
NEAR = 4  # classes that the last two lengths of a sequence may stray


def _knapsack(price: np.ndarray, size: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """How many of each size (ascending) the multiset of the highest price has, and that price."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
    upto = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if upto[c]:
            total = price[: upto[c]] + best[c - size[: upto[c]]]
            j = int(total.argmax())
            if total[j] > best[c]:
                best[c], take[c] = total[j], j
    out, c = np.zeros(len(size), dtype=np.int64), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            out[take[c]] += 1
            c -= size[take[c]]
    return out, float(best[capacity])


def fractional(need: np.ndarray, size: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[np.ndarray, float]], tuple[np.ndarray, ...]]:
    """Multiplicative weights for: least sum of x with sum x_c a_cj >= need_j. The configurations with their x, largest
    first, and the prices (scaled so that no configuration costs over 1 by the price that chose it), averaged over all rounds, the
    latter half and the last eighth."""
    step = float((need * size).sum()) / capacity / rounds
    cover, since = np.zeros(len(need)), (0, rounds // 2, rounds - rounds // 8 - 1)
    duals = tuple(np.zeros(len(need)) for _ in since)
    x: dict[bytes, float] = {}
    for t in range(1, rounds + 1):
        price = size * np.exp(np.clip(RATE * (t / rounds - cover / need), -30, 30))
        own, worth = _knapsack(price, size, capacity)
        for dual, first in zip(duals, since, strict=True):
            if t > first:
                dual += price / worth / (rounds - first)
        x[own.tobytes()] = x.get(own.tobytes(), 0.0) + step
        cover += step * own
    ranked = sorted(x.items(), key=lambda kv: (-kv[1], kv[0]))
    return [(np.frombuffer(k, dtype=np.int64), v) for k, v in ranked], duals


@dataclass(frozen=True)
class Packing:
    """``plan``: (configuration of lengths, multiplicity), exactly the pieces of the histogram. ``bound``: no packing has fewer sequences,
    by the averaged prices or by the sum of lengths. ``rounded``: sequences that rounding the program made, full-length pieces left out."""

    plan: list[tuple[Config, int]]
    bound: int
    rounded: int

    @property
    def sequences(self) -> int:
        return sum(times for _, times in self.plan)


def pack_histogram(histogram: dict[int, int], capacity: int) -> Packing:
    """The whole plan. Equal input gives the same plan; an empty histogram an empty one."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in histogram.items():
        left[n] = k
    plan: dict[Config, int] = {}

    def use(config: dict[int, int], times: int) -> None:
        for n, k in config.items():
            left[n] -= k * times
        key = tuple(sorted(config.items(), reverse=True))
        plan[key] = plan.get(key, 0) + times

    lengths = np.flatnonzero(left)
    bound = -(-int((lengths * left[lengths]).sum()) // capacity)
    if left[capacity]:  # each is a sequence by itself
        use({capacity: 1}, int(left[capacity]))
    width = max(1, capacity // CLASSES)
    of = np.maximum(1, (np.arange(capacity + 1) + width // 2) // width)  # a length's class is the nearest multiple of the width
    rounded, full = 0, True
    for solve in range(SOLVES):
        full = full and solve < SOLVES - LOOSE
        have = np.flatnonzero(left)
        if not len(have):
            break
        size, at = np.unique(of[have], return_inverse=True)
        need = np.bincount(at, weights=left[have])
        total = float((need * size).sum()) * width / capacity
        found, duals = fractional(need, size, capacity // width, int(min(ROUNDS, max(100, 4 * total))))
        if solve == 0:  # the dual prices of all lengths but the full ones, which are priced 1
            for by_length in (dual[at] for dual in duals):
                _, most = _knapsack(by_length, have, capacity)
                own = histogram.get(capacity, 0) + float((by_length * left[have]).sum()) / max(most, 1e-12)
                bound = max(bound, int(np.ceil(own - 1e-6)))
        took = 0
        for counts, x in found:
            times = int(x + 1e-9)
            if times == 0 and took:
                break
            took += _instantiate(np.repeat(size, counts)[::-1].tolist(), max(1, times), left, width, full, use)
        rounded += took
        if not took and not full:
            break
        full = full and took > 0  # where lengths fill no sequence to the end, room is left from the start
    while True:  # best fit decreasing: each round uses up a length, or all it can of the fullest fit
        config = _filled({}, left, capacity)
        if not config:
            return Packing(list(plan.items()), bound, rounded)
        use(config, _multiplicity(config, left))


def _filled(config: dict[int, int], left: np.ndarray, room: int) -> dict[int, int]:
    """``config`` and the longest pieces left that fit its room, longest first."""
    for n in np.flatnonzero(left[: room + 1])[::-1].tolist():
        k = min(room // n, int(left[n]) - config.get(n, 0))
        if k > 0:
            config[n] = config.get(n, 0) + k
            room -= n * k
    return config


def _multiplicity(config: dict[int, int], left: np.ndarray) -> int:
    return min(int(left[n]) // k for n, k in config.items())


def _instantiate(classes: list[int], times: int, left: np.ndarray, width: int, full: bool, use) -> int:
    """Sequences of a configuration of classes, longest first, ``times`` at most: lengths of the classes take their place, the commonest
    first, the last two so that they fill the room to the end, or else the longest that fits. What room is left takes best fit; with ``full`` a
    sequence that has room even then isn't made, and its pieces wait for the next solve."""
    capacity, done = len(left) - 1, 0

    def span(c: int, stray: int = 0) -> tuple[int, int]:
        return max(1, c * width - width // 2 - stray), min(capacity, c * width + (width - 1) // 2 + stray)

    while done < times:
        config: Counter[int] = Counter()
        room, todo = capacity, list(classes)

        def free(lo: int, hi: int) -> np.ndarray:
            out = left[lo : hi + 1].copy()
            for n, k in config.items():
                if lo <= n <= hi:
                    out[n - lo] -= k
            return out

        while todo:
            if len(todo) == 2:
                (lo, hi), (lo2, hi2) = (span(c, NEAR * width) for c in todo)
                a = np.arange(lo, min(hi, room) + 1)
                b = room - a
                ok = (b >= lo2) & (b <= hi2)
                if ok.any():
                    first, second = free(lo, min(hi, room)), free(lo2, hi2)
                    both = np.zeros(len(a), dtype=np.int64)
                    both[ok] = np.where(a[ok] == b[ok], first[ok] // 2, np.minimum(first[ok], second[b[ok] - lo2]))
                    j = int(both.argmax())
                    if both[j] > 0:
                        config[int(a[j])] += 1
                        config[int(b[j])] += 1
                        room, todo = 0, []
                        break
            lo, hi = span(todo.pop(0))
            have = free(lo, min(hi, room)) if lo <= room else np.zeros(0, dtype=np.int64)
            good = np.flatnonzero(have > 0)
            if not len(good):  # the class is used up
                return done
            n = lo + int(good[have[good].argmax()] if todo else good[-1])
            config[n] += 1
            room -= n
        whole = _filled(dict(config), left, room)
        if full and sum(n * k for n, k in whole.items()) < capacity:
            return done
        now = min(times - done, _multiplicity(whole, left))
        use(whole, now)
        done += now
    return done


def configurations(histogram: dict[int, int], capacity: int) -> list[tuple[Config, int]]:
    """(configuration, multiplicity) that together hold exactly the pieces of the histogram."""
    return pack_histogram(histogram, capacity).plan


def placement(plan: list[tuple[Config, int]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: the first rank of each run, its multiplicity, first sequence and first offset. Rank r of a run that
    starts at a goes to sequence base + (r - a) % times, slot (r - a) // times."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for config, times in plan:
        at = 0
        for n, k in config:
            runs.setdefault(n, []).append((taken.get(n, 0), times, base, at))
            taken[n] = taken.get(n, 0) + k * times
            at += n * k
        base += times
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for n, r in runs.items()}


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids and ``end_id``. A document over ``capacity``
    ids is cut: what doesn't fill a piece comes first, then full pieces. Null text counts as empty (one
    piece, the end id). ``tokenizer``: path of a tokenizer file, the same on every machine."""
    tail = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=False)
        encode = rank_encoder(vocabulary, public_tokenizers.PATTERN)  # the same ids as the library's, in a third of its time
        coder = ChunkEncoder(lambda xs: list(map(encode, xs)), public_tokenizers.PATTERN)
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(coder.encode(text.as_py() or "") + tail)
                n = len(ids) // 4
                ends = range(n % capacity or capacity, n + 1, capacity)
                start = 0
                for i, end in enumerate(ends):
                    rows.append((key, i, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                    start = end
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32; other columns are left out).

    Equal pieces are interchangeable; no two overlap, offsets are gapless from 0. An empty table gives an
    empty result."""
    rows, _ = written(cut, "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = placement(configurations(histogram, capacity), capacity)
    ranked = gapless(rows, "length", ["doc_id", "piece", "start", "ids_crc32"], "rank", by=["doc_id", "piece"])
    schema = PIECES + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(n), dtype=np.int64), np.empty(len(n), dtype=np.int64)
            for size in np.unique(n):
                rows = n == size
                first, times, base, at = where[int(size)]
                run = np.searchsorted(first, rank[rows], side="right") - 1
                past = rank[rows] - first[run]
                sequence[rows] = base[run] + past % times[run]
                offset[rows] = at[run] + past // times[run] * size
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.split()[0]) for f in PIECES.split(", ")], pa.array(sequence), pa.array(offset)], [f.split()[0] for f in schema.split(", ")]
            )

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048) -> DataFrame:
    """Pieces of every document with their places (see ``pieces`` and ``pack``); doc_id and text are read, other columns left out,
    whatever their names. Null text counts as empty. Rows that repeat, and rows without doc_id, are packed each for itself; texts
    of any length are cut, none is dropped. Among equal lengths (doc_id, piece, start, checksum) decides who goes first. An empty table gives an empty result."""
    import public_tokenizers

    return pack(pieces(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), capacity), capacity)


def op8_config_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
