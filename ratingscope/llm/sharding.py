"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (operator 4).

Each shard has virtual nodes on a ring; a key belongs to the next node clockwise. Shards have a capacity,
and what overflows a full shard goes on clockwise to the next one with room. Capacities differ by one at
most and add up to the number of rows, so the counts differ by one at most.

All keys of an arc (between two nodes) share their way round the ring, so which shard takes how
many of them depends on the arcs' counts alone. Spark counts the arcs (shards x nodes numbers, a fixed
bound whatever the input), ``spread`` walks the ring over these numbers, and each row finds its shard by its
rank in its arc. Ranks come from cells of some 20,000 rows, ordered by a hash, and running totals over the cells.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a cell, on average.
CELL_ROWS = 20_000


def ring(shards: int, nodes: int) -> tuple[np.ndarray, list[int]]:
    """Positions of all virtual nodes, ascending, and the shard of each. A shard's nodes don't depend on how
    many shards there are."""
    at = sorted((int.from_bytes(hashlib.blake2b(f"{s}/{k}".encode(), digest_size=8).digest(), "big", signed=True), s) for s in range(shards) for k in range(nodes))
    return np.array([p for p, _ in at], dtype=np.int64), [s for _, s in at]


def spread(counts: dict[int, int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, from, to, shard, base): of each arc's rows, by rank, those in [from, to) go to the shard, where
    their slots begin at base.

    Rows go to the owner of their arc's node; a full shard sends what it can't take on to the next node, a
    step of all arcs at a time, lower arcs first. Takes counts only."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    taken = defaultdict(list)  # arc -> [(shard, rows)]
    waiting = {arc: (arc, n) for arc, n in counts.items() if n}  # arc -> node that it has come to, rows
    while waiting:
        further = {}
        for arc in sorted(waiting):
            node, n = waiting[arc]
            shard = owners[node]
            take = min(n, room[shard])
            if take:
                room[shard] -= take
                taken[arc].append((shard, take))
            if n > take:
                further[arc] = ((node + 1) % len(owners), n - take)
        waiting = further
    used, out = [0] * shards, []
    for arc in sorted(taken):
        rank = 0
        for shard, n in taken[arc]:
            out.append((arc, rank, rank + n, shard, used[shard]))
            rank, used[shard] = rank + n, used[shard] + n
    return out


def assign(df: DataFrame, shards: int, nodes: int = 64, key: str = "doc_id", text_col: str = "text", order: tuple[str, ...] = ()) -> DataFrame:
    """(key, size long, text_crc32 long, shard int, slot long): the shard of every row and its place there.

    size is the text's UTF-8 bytes plus 8; a null text has no bytes, and the CRC of none (0). A null
    key is a key like others. Rows of equal key share their place on the ring; a key with more rows than
    a shard has room for flows over into the next. Ties within an arc are ordered by a hash of key and
    CRC, the key, the CRC and ``order``; rows equal in all of them are interchangeable. An empty table gives
    no rows. With one more shard only the rows that it takes, and those which the smaller
    capacities push on, move. Of other columns only those named in ``order`` are read."""
    spark = df.sparkSession
    positions, owners = ring(shards, nodes)

    @F.pandas_udf("int")
    def arc_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(positions, place.to_numpy(), side="left") % len(positions)).astype("int32")

    rows = df.select(
        F.col(key).alias("_key"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        *(F.col(c).alias(f"_by{k}") for k, c in enumerate(order)),
    )
    total = df.count()
    cells = max(1, -(-total // (len(owners) * CELL_ROWS)))
    # the place comes from the key alone, the cell from the whole row: a key with many rows has many cells
    rows = rows.withColumn("_arc", arc_of(F.xxhash64("_key"))).withColumn("_hash", F.xxhash64("_key", "text_crc32", *(f"_by{k}" for k in range(len(order))), F.lit("cell")))
    rows = rows.withColumn("_cell", F.pmod("_hash", F.lit(cells)))
    by_cell = rows.groupBy("_arc", "_cell").agg(F.count("*").alias("_n"))
    counts = {r[0]: r[1] for r in by_cell.groupBy("_arc").agg(F.sum("_n")).collect()}  # at most shards x nodes numbers
    splits = spark.createDataFrame(spread(counts, owners, shards), "_at int, _from long, _to long, shard int, _base long")

    starts = by_cell.withColumn("_start", F.sum("_n").over(Window.partitionBy("_arc").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)))
    in_cell = F.row_number().over(Window.partitionBy("_arc", "_cell").orderBy("_hash", "_key", "text_crc32", *(f"_by{k}" for k in range(len(order)))))
    ranked = rows.withColumn("_in", in_cell).join(starts.select("_arc", "_cell", F.coalesce("_start", F.lit(0)).alias("_start")), ["_arc", "_cell"])
    ranked = ranked.withColumn("_rank", F.col("_start") + F.col("_in") - 1)
    # the splits are at most shards x (nodes + 1) rows, so they are broadcast
    placed = ranked.join(F.broadcast(splits), (F.col("_arc") == F.col("_at")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.select(F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_base") + F.col("_rank") - F.col("_from")).alias("slot"))
