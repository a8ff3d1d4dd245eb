"""Shards of nearly equal bytes: sampled splitters, range partitioning, subdivision of overfull ranges.

Records are ordered by (hash of the text, id, number of the row read), so equal texts lie side by side and no two records
are equal. A size-weighted sample of these keys gives the splitters; ranges that still hold over twice their share are
sampled again and subdivided, also inside a group of equal texts. Exact sizes of the ranges then tell in which range each
shard ends, and within these few the exact record. DataFrame functions only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, partitions

SHARDS = 8
#: Ranges, and sampled keys for each range. Both bound what the driver gets, at any size of the input.
LEAST_RANGES, MOST_RANGES, SAMPLES = 64, 4096, 8
#: A shard ends at the edge of a group of equal texts if that moves its end by no more than this part of a shard.
SNAP = 0.005
LEAST, MOST = -(2**63), 2**63 - 1
KEY = "struct<k:bigint,d:bigint,r:bigint>"


def _records(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, size, text_crc32, key): what decides, without the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("k"))
    key = F.struct("k", F.coalesce("doc_id", F.lit(LEAST)).alias("d"), F.monotonically_increasing_id().alias("r"))
    return own.select("doc_id", "size", "text_crc32", key.alias("key"))


def _keys(found: list) -> Column:
    """Sorted keys as one constant array."""
    return F.from_json(F.lit(json.dumps([{"k": k, "d": d, "r": r} for k, d, r in found])), f"array<{KEY}>")


def _range_of(key: Column, splitters: list) -> Column:
    """How many splitters aren't above the key: the number of its range. A binary search over a constant array."""
    if not splitters:
        return F.lit(0)
    cuts, n = _keys(splitters), len(splitters)
    steps = F.lit([2**i for i in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(cuts, F.least(at + step, F.lit(n)) - 1) <= key), at + step).otherwise(at))


def _sample(records: DataFrame, mean: float, seed: int) -> list:
    """Keys sorted, each record drawn with the odds size / mean: as many as sizes hold `mean`, give or take their root."""
    u = F.shiftrightunsigned(F.xxhash64("key", F.lit(seed)), 11) / float(2**53)
    return sorted(tuple(r["key"]) for r in records.filter(u * mean < F.col("size")).select("key").collect())


def _quantiles(keys: list, parts: int) -> list:
    return [keys[len(keys) * i // parts] for i in range(1, parts)] if len(keys) >= parts else keys


def splitters(records: DataFrame, ranges: int) -> tuple[list, list]:
    """Splitters between ranges of at most about twice their share of the bytes, and (range, bytes, rows) of each that has rows.

    A record larger than that is a range's only way to be larger. Rounds end when nothing is overfull, or can be split.
    """
    total = records.agg(F.sum("size")).first()[0] or 0
    share, found, seed = total / ranges, [], 0
    if total:
        found = sorted(set(_quantiles(_sample(records, share / SAMPLES, seed), ranges)))
    while True:
        dealt = records.withColumn("range", _range_of(F.col("key"), found))
        sizes = dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("size").alias("most")).orderBy("range").collect()
        over = {r["range"]: r for r in sizes if r["bytes"] > 2 * share and r["bytes"] - r["most"] > share}
        seed += 1
        drawn = _sample(dealt.filter(F.array_contains(F.lit(list(over)), F.col("range"))), share / SAMPLES, seed) if over else []
        more, at = set(), 0
        for i in sorted(over):
            low = found[i - 1] if i else None
            own = [k for k in drawn if (low is None or k > low) and (i >= len(found) or k < found[i])]
            more.update(_quantiles(own, max(2, round(over[i]["bytes"] / share))))
        if not more:
            return found, [(r["range"], r["bytes"], r["n"]) for r in sizes]
        found = sorted({*found, *more})


def _ends(records: DataFrame, found: list, sizes: list, shards: int) -> list:
    """The keys with which shards 1, 2, ... begin; fewer if there are too few records."""
    total, before, wanted = sum(b for _, b, _ in sizes), 0, {}
    for i, size, _ in sizes:
        for j in range(1, shards):
            if before < total * j / shards <= before + size:
                wanted.setdefault(i, []).append((j, before))
        before += size
    if not wanted:
        return []
    within = records.withColumn("range", _range_of(F.col("key"), found)).filter(F.array_contains(F.lit(list(wanted)), F.col("range")))
    offsets = F.from_json(F.lit(json.dumps({str(i): x[0][1] for i, x in wanted.items()})), "map<string,bigint>")
    end = F.element_at(offsets, F.col("range").cast("string")) + F.sum("size").over(Window.partitionBy("range").orderBy("key"))
    first = lambda j: F.min(F.when(F.col("end") >= total * j / shards, F.struct("end", "key", "size"))).alias(str(j))
    cuts = within.withColumn("end", end).agg(*(first(j) for x in wanted.values() for j, _ in x)).first().asDict()
    cuts = {int(j): hit for j, hit in cuts.items()}
    held = sorted({hit["key"]["k"] for hit in cuts.values()})
    spans = records.agg(*(f(F.when(c, F.col("size"))).alias(f"{n}{i}") for i, k in enumerate(held) for n, f, c in (("a", F.sum, F.col("key.k") < k), ("b", F.sum, F.col("key.k") <= k)))).first()
    starts = []
    for j, hit in sorted(cuts.items()):
        target, (k, d, r) = total * j / shards, tuple(hit["key"])
        # The target lies within this record: the shard begins with it or after it, whichever is nearer.
        edges = [(abs(hit["end"] - hit["size"] - target), 1, (k, d, r)), (abs(hit["end"] - target), 1, (k, d, r + 1))]
        i = held.index(k)
        low, high = spans[f"a{i}"] or 0, spans[f"b{i}"]
        for at, key in ((low, (k, LEAST, LEAST)), (high, (k, MOST, MOST))):
            if abs(at - target) <= SNAP * total / shards:
                edges.append((abs(at - target), 0, key))
        starts.append(min(edges, key=lambda e: (e[1], e[0]))[2])
    return starts


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, key, shard, slot) for each row of docs.

    `size` is the UTF-8 bytes of the text plus one, a null text counts as an empty one. Shards are intervals of the key's
    order, so equal texts share one unless they straddle its end; a group that is larger than a shard is divided by id.
    Shards differ from an equal part of the bytes by a record, or SNAP of a shard where that keeps a group whole. `slot`
    is gapless from 0 in a shard. Null ids come first within a text, repeated rows are divided by the order they are read in.
    A table with fewer rows than shards leaves shards empty; an empty one gives no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    records = materialize(_records(docs, id_col, text_col), "records")
    ranges = min(MOST_RANGES, max(LEAST_RANGES, 4 * partitions(spark)))
    found, sizes = splitters(records, ranges)
    starts = _ends(records, found, sizes, shards)
    begun = [F.when(F.col("key") >= _keys([s]).getItem(0), 1).otherwise(0) for s in starts]
    shard = sum(begun[1:], begun[0]) if begun else F.lit(0)
    dealt = records.select("*", _range_of(F.col("key"), found).alias("_range"), shard.cast("int").alias("shard"))
    w = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range and shard it touches: ranges plus shards at most.
    before = dealt.groupBy("_range", "shard").count().select("_range", "shard", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_before"))
    slot = F.col("_before") + F.row_number().over(Window.partitionBy("_range", "shard").orderBy("key")) - 1
    out = dealt.join(F.broadcast(before), ["_range", "shard"]).withColumn("slot", slot)
    return out.select("doc_id", "size", "text_crc32", "key", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Parquet files of doc_id and text under shard=N, each in the order of slots over its files' names.

    A shard is written by several tasks, so a large one needs no task that holds it.
    """
    placed = sharded(docs, shards)
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_k"), "text")
    place = placed.select("doc_id", F.col("key.k").alias("_k"), "shard", "slot", F.row_number().over(Window.partitionBy("key.k", "key.d").orderBy("slot")).alias("_n"))
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy("_k", "_id").orderBy("_k")))
    both = place.join(own, (place["_k"] == own["_k"]) & place["doc_id"].eqNullSafe(own["_id"]) & (place["_n"] == own["_n"]))
    both.select("doc_id", "text", "shard", "slot").repartitionByRange(partitions(docs.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes."""
    placed = sharded(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
