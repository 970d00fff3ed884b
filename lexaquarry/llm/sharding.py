"""Consistent hashing with virtual nodes and bounded loads.

Each shard stands at VNODES points of a ring of 2**63 places. A key belongs to the first point clockwise of its hash; no
shard takes more than ceil((1 + SLACK) keys / shards) keys, and what overflows a full shard continues clockwise to the
next shard. Keys are settled in rounds: in round r every key still without a shard asks its r-th distinct shard
clockwise, and a shard with room for some of them takes them by place on the ring. So the result depends on the keys
alone, not on their order, balance is guaranteed, and a change of the shards moves few keys.

Only the number of keys on each arc of the ring matters for the rounds. It is counted on the executors, and the driver
works on arcs alone (shards x VNODES of them, whatever the number of keys). The keys that a shard takes from an arc are
neighbours on it, so a shard's share is a range of places: where it begins is looked up among the distinct keys, ranked by
a shuffle of about 30 bytes each, and rows find their range in a broadcast table of at most twice as many ranges as arcs
and shards. Rows themselves are not shuffled, whatever they carry and however many have the same key.
"""

from __future__ import annotations

import bisect
import hashlib
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import materialize, release, table

SHARDS = [f"shard-{i:03d}" for i in range(64)]
VNODES = 128
SLACK = 0.05
RING = 1 << 63


def ring(shards: list[str], vnodes: int = VNODES) -> list[tuple[int, str]]:
    """The points of the ring in order; every shard's points are its own affair, so others don't move with it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be given, each once")
    if vnodes < 1:
        raise ValueError("vnodes must be positive")
    return sorted((int.from_bytes(hashlib.sha256(f"{s}#{v}".encode()).digest()[:8], "big") >> 1, s) for s in shards for v in range(vnodes))


def place(key):
    """A key's place on the ring; null has one too."""
    return F.xxhash64(F.lit("key"), F.coalesce(key.cast("string"), F.lit("")), key.isNull()).bitwiseAND(F.lit(RING - 1))


def capacity(keys: int, shards: int, slack: float) -> int:
    return max(-(-keys // shards), math.ceil(keys * (1 + slack) / shards - 1e-9))


def settle(points: list[tuple[int, str]], counts: dict[int, int], slack: float = SLACK) -> list[tuple[int, int, int, str, int]]:
    """(arc, first rank, behind the last rank, shard, hops) for each run of ranks of an arc (ranks from 0)."""
    if slack < 0:
        raise ValueError("slack must not be negative")
    shards = sorted({s for _, s in points})
    total = sum(counts.values())
    room = dict.fromkeys(shards, capacity(total, len(shards), slack))
    walks = {}
    for arc in counts:
        seen, walk = set(), []
        for i in range(len(points)):
            s = points[(arc + i) % len(points)][1]
            if s not in seen:
                seen.add(s)
                walk.append(s)
                if len(walk) == len(shards):
                    break
        walks[arc] = walk
    at = dict.fromkeys(counts, 0)
    out = []
    for hop in range(len(shards)):
        open_ = [a for a in sorted(counts) if at[a] < counts[a]]
        if not open_:
            break
        for arc in open_:
            s = walks[arc][hop]
            n = min(room[s], counts[arc] - at[arc])
            if n:
                out.append((arc, at[arc], at[arc] + n, s, hop))
                at[arc] += n
                room[s] -= n
    return out


def assign_shards(rows: DataFrame, key: str, shards: list[str] = SHARDS, vnodes: int = VNODES, slack: float = SLACK) -> DataFrame:
    """All columns of ``rows`` with ``shard`` and ``hops`` (full shards that the key passed) in place of columns so named.

    Rows of one key are one key and go to one shard; loads are bounded in keys. Null is a key like others, and so is an
    empty text. Keys of any length count whole. Two keys of one place on the ring are settled in the order of their text.
    Repeated rows stay, columns of any other name are kept. An empty table gives no rows.
    """
    spark = rows.sparkSession
    points = ring(shards, vnodes)
    starts = [p for p, _ in points]
    rows = rows.drop("shard", "hops")
    names = rows.columns
    # the arc is found by a binary search in the sorted points, an array of fixed size
    bounds = spark.createDataFrame([(i, (starts[i - 1] + 1) if i else 0, p) for i, p in enumerate(starts)] + [(0, starts[-1] + 1, RING - 1)], "arc int, low bigint, high bigint")
    shift = 63 - 12
    spread = bounds.filter("low <= high").withColumn("slot", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright("high", shift))))
    # a key's arc begins behind the previous point
    turned = F.when(F.col("h") > starts[-1], F.col("h") - F.lit(RING - 1) - 1).otherwise(F.col("h"))  # RING itself is no bigint
    keys = rows.select(F.col(f"`{key}`").cast("string").alias("k"), place(F.col(f"`{key}`")).alias("h")).distinct()
    on = keys.withColumn("slot", F.shiftright("h", shift)).join(F.broadcast(spread), "slot").filter("h between low and high").select("arc", turned.alias("at"), "k")
    ranked = materialize(on.withColumn("rank", F.row_number().over(Window.partitionBy("arc").orderBy("at", F.col("k").asc_nulls_first())) - 1), "ranks")
    counts = {r[0]: r[1] + 1 for r in ranked.groupBy("arc").agg(F.max("rank")).collect()}
    plan = settle(points, counts, slack)
    runs = spark.createDataFrame([(a, low, s, hop) for a, low, _, s, hop in plan], "arc int, rank int, shard string, hops bigint")
    begin: dict[int, list[tuple]] = {}
    for r in ranked.join(F.broadcast(runs), ["arc", "rank"]).collect():  # a row a range
        begin.setdefault(r.arc, []).append((r.rank, r["at"], r.k, r.shard, r.hops))
    release(ranked)
    ranges = []
    for arc, found in begin.items():
        found.sort()
        for x, y in zip(found, [*found[1:], None]):
            ranges.append((arc, *x[1:], y is not None, y and y[1], y and y[2]))
    ranges = spark.createDataFrame(ranges, "arc int, from_at bigint, from_k string, shard string, hops bigint, ends boolean, to_at bigint, to_k string")
    spread = F.broadcast(spread.join(F.broadcast(ranges), "arc"))
    placed = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{key}`").cast("string").alias("k"), place(F.col(f"`{key}`")).alias("h"))
    # whether (at, k) stands at a range's first key or behind it; null is before any text
    behind = lambda at, k: (F.col("at") > F.col(at)) | ((F.col("at") == F.col(at)) & (F.col(k).isNull() | F.coalesce(F.col("k") >= F.col(k), F.lit(False))))
    met = placed.withColumns({"slot": F.shiftright("h", shift), "at": turned}).join(spread, "slot").filter("h between low and high")
    done = met.filter(behind("from_at", "from_k") & (~F.col("ends") | ~behind("to_at", "to_k")))
    return done.select("row.*", "shard", "hops")


def shard_of(points: list[tuple[int, str]], h: int) -> str:
    """The shard of a place where no shard is full."""
    return points[bisect.bisect_left([p for p, _ in points], h) % len(points)][1]


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whole, with its shard."""
    return assign_shards(table(spark, sf_dir, "documents"), "doc_id")
