"""Operator 1, sharding: balanced label propagation over documents linked by equal texts.

Every document starts in the shard of its id's hash. In each round a group of equal texts counts
its members by shard (pre-aggregated, so that a hot group is a few rows) and names the shard with
most of them that still has room; a join brings that target to the members, and those whose own
shard holds fewer of their neighbours ask to move. Quotas keep linked rows within a shard's
even share: the (from, to) demands, at most shards x shards numbers, are compared with the room,
and a hash lets through the share of each that fits. Unlinked rows cost no cut edge, so they
make way: at the end a shard above its even count hands over its last rows, unlinked ones first.

The order that this needs, which is also the slot, comes from counts of small buckets, their
running sums and a row number inside each bucket; no window spans a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, documents, id_in, id_out

GROUP = ["text_hash", "text_crc32", "size"]
BUCKET_ROWS = 50_000


def _choice(values: dict, *keys: Column) -> Column:
    """The value for the keys' numbers, from a few on the driver; null where there is none."""
    out = F.lit(None)
    for key, value in values.items():
        test = F.lit(True)
        for column, part in zip(keys, key if isinstance(key, tuple) else (key,), strict=True):
            test = test & (column == F.lit(part))
        out = F.when(test, F.lit(value)).otherwise(out)
    return out


def _round(state: DataFrame, k: int, shards: int, share: int) -> tuple[DataFrame, int]:
    """One round over the linked rows: the new state, and the moves asked for."""
    load = {r.shard: r.n for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    full = [s for s in range(shards) if load.get(s, 0) >= share]
    cells = state.groupBy(*GROUP, "shard").agg(F.count("*").alias("n"))
    best = F.max(F.when(~F.col("shard").isin(full), F.struct("n", F.xxhash64("text_hash", "shard").alias("tie"), "shard")))
    target = cells.groupBy(*GROUP).agg(best.alias("best"), F.sum("n").alias("members"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("by_shard"))
    target = target.select(*GROUP, F.col("best.shard").alias("target"), "best.n", "best.tie", "members", "by_shard")
    here = F.struct(F.element_at("by_shard", F.col("shard")).alias("n"), F.xxhash64("text_hash", "shard").alias("tie"))
    wish = state.join(target, GROUP).withColumn("to", F.when((F.col("target") != F.col("shard")) & (here < F.struct("n", "tie")), F.col("target")))
    wish = cut(wish.select("uid", *GROUP, "shard", "to", "members"), "wishes")
    demand = {(r.shard, r.to): r.n for r in wish.filter("to is not null").groupBy("shard", "to").agg(F.count("*").alias("n")).collect()}
    through = {}
    for to in range(shards):
        asked = sum(n for (_, t), n in demand.items() if t == to)
        room = max(0, share - load.get(to, 0))
        through |= {(s, t): min(1.0, room / asked) for (s, t) in demand if t == to}
    # a group moves as one, but for those that fill a good part of a shard
    unit = F.pmod(F.when(F.col("members") * 16 < share, F.xxhash64(*GROUP, F.lit(k))).otherwise(F.xxhash64("uid", F.lit(k))), F.lit(1_000_003)) / 1_000_003
    moved = F.when(unit < _choice(through, F.col("shard"), F.col("to")), F.col("to")).otherwise(F.col("shard"))
    return wish.select("uid", *GROUP, moved.alias("shard")), sum(demand.values())


def propagate(docs: DataFrame, shards: int = 8, rounds: int = 10) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row of docs. Shards differ by at most one
    row, and slots of a shard count from 0 without gaps; rows of equal texts share few shards.

    A null text counts as empty (size 1); a null doc_id is a document like others; rows that
    repeat are placed each, and are linked. Other columns are ignored; an empty table gives an
    empty result."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(id_in(), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    rows = cut(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    total = rows.count()
    share = total // shards
    groups = cut(rows.groupBy(*GROUP).agg(F.count("*").alias("members")).filter("members > 1").select(*GROUP), "groups")
    first = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    state = cut(first.join(groups, GROUP, "left_semi").select("uid", *GROUP, "shard"), "linked")
    for k in range(rounds):
        state, asked = _round(state, k, shards, share)
        state = cut(state, "state")
        if not asked:
            break
    placed = first.join(state.select("uid", F.col("shard").alias("moved")), "uid", "left")
    placed = placed.select("uid", "doc_id", "size", "text_crc32", "text_hash", F.coalesce("moved", "shard").alias("shard"), F.col("moved").isNull().cast("int").alias("alone"))
    placed = cut(placed.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(max(1, total // (2 * shards * BUCKET_ROWS))))), "placed")

    sizes = placed.groupBy("shard", "alone", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("alone", "bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("shard", "alone", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "alone", "bucket").orderBy("text_hash", "uid")) - 1
    ranked = placed.withColumn("inside", inside).join(sizes, ["shard", "alone", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))

    load = {r.shard: r.n for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    load = {s: load.get(s, 0) for s in range(shards)}
    large = sorted(load, key=lambda s: (-load[s], s))[: total % shards]
    quota = {s: share + (s in large) for s in range(shards)}
    spare, given = {}, 0
    for s in range(shards):
        spare[s] = given - quota[s]
        given += max(0, load[s] - quota[s])
    over = F.col("rank") >= _choice(quota, F.col("shard"))
    turn = F.col("rank") + _choice(spare, F.col("shard"))
    shard, slot, taken = F.lit(None), F.lit(None), 0
    for s in range(shards):
        lack = max(0, quota[s] - load[s])
        here = (turn >= taken) & (turn < taken + lack)
        shard, slot = F.when(here, F.lit(s)).otherwise(shard), F.when(here, turn - taken + load[s]).otherwise(slot)
        taken += lack
    shard = F.when(over, shard).otherwise(F.col("shard")).cast("int")
    slot = F.when(over, slot).otherwise(F.col("rank")).cast("long")
    return ranked.select(id_out(), "size", "text_crc32", shard.alias("shard"), slot.alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = propagate(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
