"""Hierarchical weighted hash tree: documents to shards by region, rack, shard.

At each level every child of the chosen node draws a hash of the key and the
child's name, read as a uniform u in (0, 1), and the child with the smallest
-ln(u) / weight wins; a child's share is its weight over its siblings'. A draw
depends on nothing but the key, the child and its weight. So when a weight
changes, rows move only into (weight up) or out of (weight down) subtrees on
the changed path, and all others keep their place. ``grown`` opens a new shard
as a subtree of its own under the root, so rows move into it and nowhere else.

Nulls: a null key is a key like any other (all such rows share a shard); a null
text has no bytes. Repeated rows get the same shard and different slots. Equal
texts under different keys are not kept together: the key alone decides.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, let


@dataclass(frozen=True)
class Node:
    """A region or rack with children, or a shard (named shard<number>, ``shard`` set)."""

    name: str
    weight: float = 1.0
    shard: int | None = None
    children: tuple["Node", ...] = field(default=())


def balanced_tree(regions: int = 4, racks: int = 2, shards: int = 5) -> tuple[Node, ...]:
    """Equal shards 0, 1, ... in ``racks`` racks a region."""
    def rack(r: int, k: int) -> Node:
        first = (r * racks + k) * shards
        return Node(f"region{r}/rack{k}", shards, None, tuple(Node(f"shard{first + i}", 1.0, first + i) for i in range(shards)))

    return tuple(Node(f"region{r}", racks * shards, None, tuple(rack(r, k) for k in range(racks))) for r in range(regions))


def leaves(nodes: tuple[Node, ...]) -> list[int]:
    return [s for n in nodes for s in ([n.shard] if n.shard is not None else leaves(n.children))]


def grown(tree: tuple[Node, ...], weight: float = 1.0) -> tuple[Node, ...]:
    """``tree`` with one more shard, in a region and rack of its own."""
    new = max(leaves(tree)) + 1
    leaf = Node(f"shard{new}", weight, new)
    return (*tree, Node(f"region-of-{new}", weight, None, (Node(f"rack-of-{new}", weight, None, (leaf,)),)))


def _children(nodes: tuple[Node, ...], name: str = "") -> dict[str, tuple[Node, ...]]:
    """Every inner node's children, by its name; the root's name is empty."""
    out = {name: nodes}
    for n in nodes:
        if n.children:
            out |= _children(n.children, n.name)
    return out


def assign_shards(df: DataFrame, tree: tuple[Node, ...], key: str = "doc_id", name: str = "shard") -> DataFrame:
    """``df`` with its shard: three winning draws a row, no shuffle. The tree is a constant of the plan."""
    kinds = _children(tree)
    table = F.create_map(*(c for k, v in kinds.items() for c in (F.lit(k), F.array(*(F.struct(F.lit(n.name).alias("name"), F.lit(float(n.weight)).alias("weight")) for n in v)))))

    def winner(children: Column) -> Column:
        def draw(child: Column) -> Column:
            u = (F.shiftrightunsigned(F.xxhash64(F.col(key), child["name"]), 11) + 0.5) / float(2**53)
            return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["name"].alias("name"))

        return F.array_min(F.transform(children, draw))["name"]

    below = lambda node: winner(F.element_at(table, node))
    shard = let(below(F.lit("")), lambda region: let(below(region), below))
    return df.withColumn(name, F.substring(shard, 6, 20).cast("int"))


def shard_documents(docs: DataFrame, tree: tuple[Node, ...] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; an empty table gives none."""
    tree = tree or balanced_tree()
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    rows = assign_shards(assign_shards(rows, tree), grown(tree), name="grown_shard")
    placed = gapless_rank(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot", docs.count())
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
