"""Sharding: longest-processing-time scheduling of groups that must stay together.

Groups (rows of one key, such as copies of a text) are put in order of size, and each goes to
the shard with the least bytes so far, through a heap. The heap is one sequential loop, so its
input has to be bounded whatever the corpus: every group of at least ``total / grain`` bytes is an
item of its own, and smaller groups, in order of size, are joined into items of about that many
bytes. There are at most about ``2 * grain`` items plus one per task, and two shards end at most
one small item apart unless a single group is larger than a shard's share.

Only the group's key (SHA-256 of its text), bytes and item travel; texts are read once.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import drop_path, materialise, running_positions


def lpt(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Shard of each (item, size): largest first, to the least-loaded shard; ties to the smaller item and shard."""
    heap, to = [(0, s) for s in range(shards)], {}
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        to[item] = s
        heapq.heappush(heap, (load + size, s))
    return to


def shard_documents(docs: DataFrame, shards: int = 8, grain: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, shard and slot (gapless from 0 in each shard, by id).

    Size is the UTF-8 bytes of the text plus 1. A null text counts as an empty one and shares its
    group. Repeated rows are rows of their own (same shard, different slots); null ids are kept and
    come first. Only ``id_col`` and ``text_col`` are read, so other columns can't clash. An empty
    table gives an empty table.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows, rows_at = materialise(
        docs.select(
            F.col(f"`{id_col}`").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("_key"),
        ),
        "shard-rows",
    )
    # Copies are summed in each task before the shuffle, so a hot text costs one row a task.
    groups = rows.groupBy("_key").agg(F.sum("size").alias("bytes"))
    groups = groups.withColumn("_minus", -F.col("bytes"))
    ordered, ordered_at = running_positions(groups, ["_minus", "_key"], "bytes", "start")
    total = ordered.agg(F.max(F.col("start") + F.col("bytes"))).first()[0] or 1
    each = max(1, -(-total // grain))
    # In order of size, a group of its own item starts at its own position; small ones share the item of their stretch of bytes.
    item = F.when(F.col("bytes") >= each, -F.floor(F.col("start") / each) - 1).otherwise(F.floor(F.col("start") / each))
    placed = ordered.select("_key", "bytes", item.cast("long").alias("item"))
    items = placed.groupBy("item").agg(F.sum("bytes").alias("bytes")).collect()  # at most about 2 * grain rows
    to = lpt([(r["item"], r["bytes"]) for r in items], shards)
    table = spark.createDataFrame(list(to.items()) or [(0, 0)], "item long, shard int")
    keyed = placed.join(F.broadcast(table), "item").select("_key", "shard")
    out, out_at = running_positions(rows.join(keyed, "_key").drop("_key").withColumn("_one", F.lit(1).cast("long")).withColumn("_tie", F.coalesce("doc_id", F.lit(-(2**63)))), ["_tie", "text_crc32"], "_one", "slot", "shard")
    done, _ = materialise(out.select("doc_id", "size", "text_crc32", "shard", "slot"), "shards")
    drop_path(spark, rows_at, ordered_at, out_at)
    return done
