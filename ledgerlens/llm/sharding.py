"""Sharding by a hierarchical weighted hash tree.

A topology is a list of leaves (region, rack, shard, weight, epoch). A row descends it: at each level
every child draws an exponential variate from a hash of (row key, child) with the child's weight as
rate, and the smallest draw wins, so a child receives rows in proportion to its weight. A changed
weight changes only that child's own draw: rows move into or out of the subtrees whose weights
changed, and nowhere else. A leaf added in a later epoch draws at the root, beside the regions, with its own
weight: inside its region it would also raise that region's draw, and rows would move into the region's old
shards. So growth by one shard takes rows only into that shard, an equal share from each of the others.

The law of ``assign`` is "key": row key and topology decide, nothing else does.

Defined results: a null key draws like the fixed key of all nulls; repeated rows share a shard and
get slots of their own; an empty table stays empty; an input column named like an output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The production tree: 3 regions of 2 racks of 4 shards; a shard of a later epoch draws at the root, beside the regions.
REGIONS, RACKS, PER_RACK = 3, 2, 4
#: Parts of a shard that are numbered apart, at any size of the table.
BUCKETS = 1024


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0
    epoch: int = 0


def tree(n_shards: int = REGIONS * RACKS * PER_RACK) -> list[Leaf]:
    """The production topology with so many shards; those beyond the first 24 are later epochs."""
    base = REGIONS * RACKS * PER_RACK
    leaves = [Leaf(s // (RACKS * PER_RACK), s // PER_RACK % RACKS, s) for s in range(min(n_shards, base))]
    return leaves + [Leaf(0, 0, s, 1.0, 1 + s - base) for s in range(base, n_shards)]


def _draw(key: Column, node: str, weight: float) -> Column:
    """Exponential variate of a node for a row: -ln(u) / weight, u in (0, 1) from 52 hash bits."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 12)
    return -F.ln((bits.cast("double") + 0.5) / float(1 << 52)) / F.lit(float(weight))


def _descend(key: Column, leaves: list[Leaf], levels: list, path: str) -> Column:
    """The shard below ``path``: draw among the children of this level, then go on in the winner."""
    if not levels:
        return F.lit(leaves[0].shard)
    groups: dict = {}
    for leaf in leaves:
        groups.setdefault(levels[0](leaf), []).append(leaf)
    if len(groups) == 1:
        (name, only), = groups.items()
        return _descend(key, only, levels[1:], f"{path}/{name}")
    draws = [
        F.struct(_draw(key, f"{path}/{name}", sum(x.weight for x in group)).alias("e"), F.lit(i).alias("i"))
        for i, (name, group) in enumerate(groups.items())
    ]
    winner = F.array_min(F.array(*draws))["i"]

    def pick(i: Column) -> Column:
        parts = [_descend(key, group, levels[1:], f"{path}/{name}") for name, group in groups.items()]
        out = F.when(i == 0, parts[0])
        for n, part in enumerate(parts[1:], 1):
            out = out.when(i == n, part)
        return out

    return F.transform(F.array(winner), pick)[0]


def shard_of(key: Column, leaves: list[Leaf]) -> Column:
    """Shard of a row key in a topology (leaves of weight 0 receive nothing)."""
    live = [x for x in leaves if x.weight > 0]
    levels = [lambda x: (x.epoch, x.region), lambda x: x.rack, lambda x: x.shard]
    return _descend(key, live, levels, "").cast("int")


def assign(df: DataFrame, key_col: str, leaves: list[Leaf], grown: list[Leaf] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Add ``shard``, a gapless ``slot`` within it, and ``grown_shard`` under a second topology.

    Slots are dealt without gathering a shard in one task: rows are numbered within (shard, bucket of the
    row) and each bucket starts at the summed counts of those before it. Their number changes slots, never shards.
    """
    kept = [c for c in df.columns if c not in ("shard", "slot", "grown_shard", "_bucket")]
    key = F.col(key_col).cast("string")
    key = F.coalesce(key, F.lit("\x00null"))
    out = df.select(
        *kept,
        shard_of(key, leaves).alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.pmod(F.xxhash64(*kept, F.lit("slot")), F.lit(buckets)).cast("int").alias("_bucket"),
    )
    sizes = out.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))  # shards x buckets rows
    before = sizes.select(
        "shard", "_bucket",
        F.coalesce(F.sum("_n").over(W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    numbered = out.withColumn("_rank", F.row_number().over(W.partitionBy("shard", "_bucket").orderBy(*kept)) - 1)
    return numbered.join(before, ["shard", "_bucket"]).select(
        *kept, "shard", (F.col("_before") + F.col("_rank")).cast("long").alias("slot"), "grown_shard",
    )


def write_shards(df: DataFrame, path: str, key_col: str, leaves: list[Leaf]) -> None:
    """Write whole rows below ``path``, one folder a shard; each task holds only its own rows."""
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("\x00null"))
    df.withColumn("shard", shard_of(key, leaves)).repartition("shard", F.pmod(F.xxhash64(key), F.lit(8))).write.partitionBy("shard").parquet(path)


def op4_hash_tree_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents dealt to 24 shards by doc_id, and where they would go with 25."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    return assign(docs, "doc_id", tree(24), tree(25)).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard",
    )
