"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. On each level every child draws an exponential number whose rate is
its weight, hashed from the row's key and the child's name, and the smallest draw wins. A child's draw
changes with its own weight alone, so a change of weight moves rows into (or out of) that subtree and
leaves the others be. Everything is built-in expressions; the tree is a literal of the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gapless, table


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class ShardTree:
    """Leaves with positive weights; a rack's or region's weight is the sum of its leaves'."""

    leaves: tuple[Leaf, ...]

    def __post_init__(self) -> None:
        if not self.leaves or any(x.weight <= 0 for x in self.leaves) or len({x.shard for x in self.leaves}) < len(self.leaves):
            raise ValueError("a tree has leaves of positive weight with distinct shard numbers")

    @classmethod
    def uniform(cls, regions: int = 4, racks: int = 2, shards: int = 5) -> ShardTree:
        n = 0
        out = []
        for a in range(regions):
            for b in range(racks):
                for _ in range(shards):
                    out.append(Leaf(f"r{a}", f"r{a}k{b}", n))
                    n += 1
        return cls(tuple(out))

    def grown(self, weight: float = 1.0) -> ShardTree:
        """One more shard, in a region and rack of its own: rows move into the new shard and nowhere else,
        as no old subtree changes its weight."""
        n = max(x.shard for x in self.leaves) + 1
        return ShardTree((*self.leaves, Leaf(f"r+{n}", f"r+{n}k0", n, weight)))

    def children(self) -> dict[str, list[tuple[str, float]]]:
        """Parent name to (child name, weight); the root is the empty name, a shard's name its number."""
        out: dict[str, dict[str, float]] = {}
        for x in self.leaves:
            for parent, child in (("", x.region), (x.region, x.rack), (x.rack, str(x.shard))):
                kids = out.setdefault(parent, {})
                kids[child] = kids.get(child, 0.0) + x.weight
        return {k: list(v.items()) for k, v in out.items()}


def _draw(key: Column, name: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of md5(key / name)."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), name)), 1, 13), 16, 10).cast("long")
    return -F.log((bits.cast("double") + 0.5) / float(2**52)) / weight


def _picker(key: Column, tree: ShardTree):
    """Parent name (a column) to the name of the child with the smallest draw."""
    pairs = []
    for parent, kids in tree.children().items():
        pairs += [F.lit(parent), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in kids])]
    of = F.create_map(*pairs)

    def pick(parent: Column) -> Column:
        drawn = F.transform(F.element_at(of, parent), lambda c: F.struct(_draw(key, c["name"], c["weight"]).alias("d"), c["name"].alias("n")))
        return F.array_min(drawn)["n"]

    return pick


def assign_shards(df: DataFrame, key: str, tree: ShardTree, prefix: str = "") -> DataFrame:
    """Adds ``{prefix}region``, ``{prefix}rack`` and ``{prefix}shard`` (int); columns of these names are replaced, others stay. Rows with a null key are placed
    by the key ``null``. Equal keys land together (of equal draws the smaller name wins); nothing else about a row matters, its
    texts least of all. Rows that repeat stay; an empty table gives an empty result."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    pick = _picker(name, tree)
    return (
        df.withColumn(f"{prefix}region", pick(F.lit("")))
        .withColumn(f"{prefix}rack", pick(F.col(f"{prefix}region")))
        .withColumn(f"{prefix}shard", pick(F.col(f"{prefix}rack")).cast("int"))
    )


def op2_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards by its doc_id, its slot there, and its shard if there were 41.

    A null text has no size but the 16 bytes and no checksum (null); a null doc_id is placed by ``null``."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    tree = ShardTree.uniform()
    placed = assign_shards(sized, "doc_id", tree)
    placed = assign_shards(placed, "doc_id", tree.grown(), "grown_")
    return gapless(placed, "shard", ["doc_id", "size", "text_crc32"], "slot", by=["doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack"
    )
