"""Sharding by fixed virtual slots: rows hash to slots for good, and a versioned map says which shard has which slot.

Shards get near equal bytes. Rebalancing (uneven growth, more or fewer shards) edits the map: overfull shards give up their
smallest slots beyond the target, and only those are dealt anew, so most rows stay where they are. The map has as many
rows as there are slots, whatever the size of the corpus; every version is kept.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rulelens.plans.storage import materialize, run_dir

SLOTS = 4096
MAP_SCHEMA = "slot int, shard int, bytes bigint"


def slot_of(key, slots=SLOTS):
    """The virtual slot of a key: fixed as long as the number of slots is."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(slots)).cast("int")


def slot_bytes(rows, slots=SLOTS):
    """`(slot, bytes)` of all slots from rows `(slot, size)`, empty ones included."""
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    held = rows.groupBy("slot").agg(F.sum("size").alias("bytes"))
    return every.join(held, "slot", "left").select("slot", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))


def edit_map(sizes, shards, previous=None):
    """`(slot, shard, bytes)`: the previous map edited for new sizes `(slot, bytes)` and shards 0 to `shards` - 1.

    A shard keeps its slots, counted from the largest down, up to its share of all bytes. All other slots (all, without a previous
    map) are dealt from the largest down, each to the shard that has the least bytes then, the first of equal ones.
    Everything is worked out from slots, of which there is a fixed number.
    """
    if shards < 1:
        raise ValueError("shards must be 1 at least")
    if previous is None:
        held = sizes.withColumn("shard", F.lit(None).cast("int"))
    else:
        held = sizes.join(previous.select("slot", F.when(F.col("shard") < shards, F.col("shard")).alias("shard")), "slot", "left")
    largest = [F.desc("bytes"), "slot"]
    upto, total = F.sum("bytes").over(Window.partitionBy("shard").orderBy(*largest)), F.sum("bytes").over(Window.partitionBy())
    held = held.withColumn("_keeps", F.col("shard").isNotNull() & (upto * shards <= total))
    one = F.struct(-F.col("bytes"), "slot", "bytes", F.when(F.col("_keeps"), F.col("shard")).alias("shard"))
    slots = held.agg(F.array_sort(F.collect_list(one)).alias("all"))
    kept, free = F.filter("all", lambda x: x["shard"].isNotNull()), F.filter("all", lambda x: x["shard"].isNull())
    slots = slots.select(kept.alias("kept"), free.alias("free"))

    def load(shard):
        return F.aggregate("kept", F.lit(0).cast("bigint"), lambda n, x: n + F.when(x["shard"] == shard, x["bytes"]).otherwise(0))

    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), load)
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("dealt"))

    def deal(state, x):
        at = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        after = F.transform(state["loads"], lambda n, i: F.when(i == at, n + x["bytes"]).otherwise(n))
        return F.struct(after.alias("loads"), F.concat(state["dealt"], F.array(at)).alias("dealt"))

    dealt = slots.select("kept", "free", F.aggregate("free", start, deal, lambda state: state["dealt"]).alias("dealt"))
    new = F.transform("free", lambda x, i: F.struct(x["slot"].alias("slot"), F.get(F.col("dealt"), i).alias("shard"), x["bytes"].alias("bytes")))
    old = F.transform("kept", lambda x: F.struct(x["slot"].alias("slot"), x["shard"].alias("shard"), x["bytes"].alias("bytes")))
    return dealt.select(F.inline(F.concat(old, new)))


def write_map(new, folder, version):
    """Store a version of the map in its own folder; a version that is there already stays as it is."""
    new.coalesce(1).write.mode("ignore").parquet(f"{folder}/version={version}")


def read_map(spark, folder, version):
    return spark.read.schema(MAP_SCHEMA).parquet(f"{folder}/version={version}")


def sized_rows(docs, slots=SLOTS, id_col="doc_id", text_col="text"):
    """`(id, size, text_crc32, slot)`, stored: UTF-8 bytes of the text plus 1, its checksum, and the row's virtual slot.

    A null text has no bytes and the checksum of nothing. The rows of an id are in one slot, those of a null id too.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    sized = docs.select(
        F.col(id_col).alias("id"),
        (F.length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        slot_of(F.col(id_col), slots).alias("slot"),
    )
    return materialize(sized.withColumn("row", F.monotonically_increasing_id()), "sized")


def numbered(rows, order, group="shard"):
    """`rows` with `place`: a gapless number from 0 in each group, by the `order` columns.

    Rows are sorted by range, so a group is spread over as many tasks as it is large; a range's numbers start after those of
    the ranges before it. The order should end in a column that tells equal rows apart, so that they can be split.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ranged = ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    ranged = materialize(ranged, "ranged")
    runs = ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(group, "_range", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    # At most a run for each range and group that meet: ranges plus groups.
    out = ranged.join(F.broadcast(runs), [group, "_range"])
    return out.withColumn("place", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")


def shard(docs, shards=16, slots=SLOTS, id_col="doc_id", text_col="text", folder=None, version=0):
    """`(id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot)`: every row's shard and its place in it.

    The law is `bytes`: shards have near equal sizes, as near as whole slots allow; so `grown_shard`, which belongs to
    laws by key, is null. `slot` numbers a shard's rows from 0 by id, checksum and size. Rows map one to one, repeated ones and
    null ids included (first in the order); other columns are not looked at; an empty table gives no rows. The map is
    stored as a version below `folder`; if that version is there already it decides, so rows that come later go to the
    shards of their slots.
    """
    folder = folder or run_dir(docs.sparkSession, "slot-map")
    rows = sized_rows(docs, slots, id_col, text_col)
    write_map(edit_map(slot_bytes(rows, slots), shards), folder, version)
    current = read_map(docs.sparkSession, folder, version).select("slot", "shard")
    placed = numbered(rows.join(F.broadcast(current), "slot"), ["id", "text_crc32", "size", "row"])
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("slot").alias("virtual_slot"),
    )
