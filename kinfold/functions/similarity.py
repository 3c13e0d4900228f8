"""String similarities in [0, 1], as Arrow-batched functions over two columns.

``ratio`` is the normalized indel similarity 2 LCS / (|a| + |b|). Two empty strings score 0 in all of them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a column of the table at a time in one whole number's bits."""
    if len(a) < len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, ch in enumerate(b):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for ch in a:
        u = row & at.get(ch, 0)
        row = ((row + u) | (row - u)) & full
    return len(b) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def prefix_ratio(a: str, b: str, n: int = 12) -> float:
    return ratio(a[:n], b[:n])


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best of common words, common and a's own, common and b's own, against each other; 1 if one set holds the other. What both begin with is common
    to them, so only the words that one side has alone are compared letter by letter."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared = x & y
    if shared and (x <= y or y <= x):
        return 1.0
    own, other = (" ".join(sorted(s)) for s in (x - y, y - x))
    if not shared:
        return ratio(own, other)
    both = sum(map(len, shared)) + len(shared)  # with a space behind each
    one, two = both + len(own), both + len(other)
    return max(2 * (both + lcs(own, other)) / (one + two), 2 * (both - 1) / (both - 1 + min(one, two)))


def _prefix_lcs(at: dict[str, int], full: int, b: str) -> list[int]:
    """lcs of a string (``at``: the places of its letters, ``full``: a bit for each) with the first 1, 2, ... letters of ``b``."""
    row, out, n = full, [], full.bit_length()
    for ch in b:
        u = row & at.get(ch, 0)
        row = ((row + u) | (row - u)) & full
        out.append(n - row.bit_count())
    return out


def _places(a: str) -> dict[str, int]:
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    return at


def partial_ratio(a: str, b: str) -> float:
    """The shorter string against every window of the longer, cut windows at its ends too. Windows cut at an end are measured in one pass each; a whole one
    only if the letters it shares with the shorter string, counted as it slides, could make it the best."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    n, full, at = len(a), (1 << len(a)) - 1, _places(a)
    ends = _prefix_lcs(at, full, b[:n])
    best = max(2 * m / (n + k) for k, m in enumerate(ends, 1))
    if len(b) == n and best == 1.0:
        return best
    best = max(best, max(2 * m / (n + k) for k, m in enumerate(_prefix_lcs(_places(a[::-1]), full, b[: -n - 1 : -1]), 1)))
    spare = {ch: x.bit_count() for ch, x in at.items()}  # of each letter: how many the window still lacks
    common = 0
    for i in range(1 - n, len(b) - n):  # the last whole window and the first are among those of the ends
        ch = b[i + n - 1]  # the letter that comes in
        if ch in spare:
            common += spare[ch] > 0
            spare[ch] -= 1
        if i > 0:
            ch = b[i - 1]  # the one that goes out
            if ch in spare:
                spare[ch] += 1
                common -= spare[ch] > 0
            if common > best * n:
                row = full
                for ch in b[i : i + n]:
                    u = row & at.get(ch, 0)
                    row = ((row + u) | (row - u)) & full
                best = max(best, 2 * (n - row.bit_count()) / (n + n))
    return best


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    at = _places(b)
    used, window, full = 0, (1 << (reach + 1)) - 1, (1 << len(b)) - 1
    mine = []
    for i, ch in enumerate(a):  # the first free place of the letter within reach
        free = at.get(ch, 0) & ~used & window
        if free:
            used |= free & -free
            mine.append(ch)
        window = (window << 1 | (i < reach)) & full
    m = len(mine)
    if not m:
        return 0.0
    theirs = [ch for j, ch in enumerate(b) if used >> j & 1]
    moved = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * weight * (1 - jaro) if jaro > 0.7 else jaro


SCORES = {f.__name__: f for f in (ratio, prefix_ratio, token_sort_ratio, token_set_ratio, partial_ratio, jaro_winkler)}


def scores(named: dict[str, str], a: Column, b: Column) -> Column:
    """A struct of scores (field: score) of two string columns, in one pass over them; null counts as empty. Equal pairs of a batch are compared once."""
    of = {field: SCORES[name] for field, name in named.items()}

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        pairs = [(p or "", q or "") for p, q in zip(x, y, strict=True)]
        known = {pair: [f(*pair) for f in of.values()] for pair in set(pairs)}
        return pd.DataFrame([known[pair] for pair in pairs], columns=list(of), dtype="float64")

    return F.pandas_udf(run, ST.StructType([ST.StructField(field, ST.DoubleType()) for field in named]))(a, b)


def score(name: str, a: Column, b: Column) -> Column:
    """One score by name."""
    return scores({name: name}, a, b)[name]
