"""Sharding by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that one bucket of the slot numbering holds on average.
BUCKET_ROWS = 50_000


@dataclass(frozen=True)
class ShardTree:
    """A tree of ``founded`` shards (``per_rack`` to a rack, ``racks`` to a region), and later shards, each of which
    opens a region of its own; ``weights`` maps a shard to a weight other than 1 (0 empties it).

    A node weighs as much as the shards below it. At each level the child with the smallest ``-ln(u) / weight`` wins,
    where ``u`` is a hash of the key, the level and the child. A child's draw depends on nothing else, so a changed weight
    moves keys only into or out of the subtrees that hold it; a new shard is a subtree of its own and takes keys only
    into itself.
    """

    shards: int
    founded: int = 16
    per_rack: int = 4
    racks: int = 2
    weights: dict[int, float] = field(default_factory=dict)

    def __post_init__(self):
        if self.shards < 1 or min(self.founded, self.per_rack, self.racks) < 1 or any(w < 0 for w in self.weights.values()):
            raise ValueError("shards and fan-outs are positive, weights not negative")

    def path(self, shard: int) -> tuple[str, str, str]:
        if shard >= self.founded:
            return f"new{shard}", f"new{shard}.0", str(shard)
        rack = shard // self.per_rack
        return f"{rack // self.racks}", f"{rack // self.racks}.{rack}", str(shard)

    def nodes(self) -> dict[str, list[tuple[str, float]]]:
        """Children of every node with their weights, the root under ''. Children of weight 0 are left out."""
        total: dict[str, dict[str, float]] = {}
        for shard in range(self.shards):
            region, rack, leaf = self.path(shard)
            weight = float(self.weights.get(shard, 1.0))
            if weight > 0:
                for parent, child in (("", "R" + region), ("R" + region, "K" + rack), ("K" + rack, "S" + leaf)):
                    children = total.setdefault(parent, {})
                    children[child] = children.get(child, 0.0) + weight
        if not total:
            raise ValueError("no shard has a weight")
        return {parent: sorted(children.items()) for parent, children in total.items()}


def _draw(key: Column, child: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(child)), 11).cast("double") + 0.5) * 2.0**-53
    return F.struct((-F.log(u) / weight).alias("draw"), F.lit(child).alias("child"))


def _choice(key: Column, children: list[tuple[str, float]]) -> Column:
    if len(children) == 1:
        return F.lit(children[0][0])
    return F.least(*[_draw(key, child, weight) for child, weight in children])["child"]


def shard_of(key: Column, tree: ShardTree) -> tuple[Column, Column, Column]:
    """(region, rack, shard) of a key by three descents; a null key hashes like any other value."""
    nodes = tree.nodes()

    def below(at: Column, parents: list[str]) -> Column:
        out = None
        for parent in parents:
            is_here = at == parent
            out = F.when(is_here, _choice(key, nodes[parent])) if out is None else out.when(is_here, _choice(key, nodes[parent]))
        return out

    region = _choice(key, nodes[""])
    regions = [c for c, _ in nodes[""]]
    rack = below(F.col("_region"), regions)
    shard = below(F.col("_rack"), [c for r in regions for c, _ in nodes[r]])
    return region, rack, shard


def with_shard(docs: DataFrame, key: str, tree: ShardTree, out: str) -> DataFrame:
    """Adds int column ``out``; needs a frame without columns _region, _rack, _shard."""
    region, rack, shard = shard_of(F.col(key), tree)
    df = docs.withColumn("_region", region).withColumn("_rack", rack).withColumn("_shard", shard)
    return df.withColumn(out, F.substring("_shard", 2, 20).cast("int")).drop("_region", "_rack", "_shard")


def shard_documents(docs: DataFrame, tree: ShardTree = ShardTree(16)) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: every document's shard by the law ``key``.

    doc_id and the tree alone decide the shard; ``grown_shard`` is the shard under one shard more, which differs only where
    the new shard took the row. ``slot`` numbers a shard's rows from 0 without gaps, by hash bucket, then doc_id, size
    and checksum: buckets number their rows apart, so a shard is never one task. size is the text's UTF-8 bytes plus 1;
    a null text has no bytes and checksum 0. A null doc_id is a key like any other. Identical rows are numbered
    together and get a slot each. Other columns of ``docs`` are ignored.
    """
    grown = ShardTree(tree.shards + 1, tree.founded, tree.per_rack, tree.racks, tree.weights)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0).cast("long")).alias("text_crc32"),
    )
    kinds = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    buckets = max(1, docs.count() // (BUCKET_ROWS * tree.shards))
    placed = with_shard(with_shard(kinds, "doc_id", tree, "shard"), "doc_id", grown, "grown_shard")
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit("bucket")), F.lit(buckets)))
    sums = placed.groupBy("shard", "bucket").agg(F.sum("copies").alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("copies").over(W.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, W.currentRow))
    numbered = placed.withColumn("last", within).join(sums.select("shard", "bucket", before.alias("base")), ["shard", "bucket"])
    first = F.col("base") + F.col("last") - F.col("copies")
    slot = F.explode(F.sequence(first, first + F.col("copies") - 1))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")
