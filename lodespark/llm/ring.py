"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Keys and virtual nodes have places on a ring of 2 ** 60. A key belongs to the first virtual node clockwise; if its shard
is full (CAPACITY times the mean load, rounded up), it goes on to the next node of a shard that isn't. Keys arrive in
ring order. That makes the rule exact without a loop over keys: documents are counted by arc between virtual nodes, a
walk over the arcs (shards * nodes of them, whatever the data) says how many of an arc's keys, in ring order, each shard
takes, and each key finds its shard by its rank in its arc. Only arcs that overflow need ranks.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespark.llm.common import cut

SHARDS = 64
NODES = 32
CAPACITY = "1.05"


def place(text: str) -> int:
    """The first 60 bits of the MD5 of text."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def place_of(col: Column) -> Column:
    return F.conv(F.substring(F.md5(col.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def ring(shards: int = SHARDS, nodes: int = NODES) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes in ring order."""
    return sorted((place(f"shard-{s}#{v}"), s) for s in range(shards) for v in range(nodes))


def quotas(counts: dict[int, int], nodes: list[tuple[int, int]], shards: int, capacity: str = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, end rank, shard): who takes which keys of each arc, arcs and ranks in ring order."""
    total = sum(counts.values())
    room = [-(-total * Fraction(capacity) // shards)] * shards
    room = [int(r) for r in room]
    out = []
    for arc in range(len(nodes)):
        left, rank, k = counts.get(arc, 0), 0, arc
        while left:
            s = nodes[k % len(nodes)][1]
            take = min(left, room[s])
            if take:
                out.append((arc, rank, rank + take, s))
                room[s] -= take
                rank += take
                left -= take
            k += 1
    return out


def assign(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES, capacity: str = CAPACITY) -> DataFrame:
    """doc_id, home (the shard of its arc) and shard, for each distinct doc_id.

    Equal doc_ids are one key; a null doc_id is none. Keys at one place come by doc_id. Texts and extra columns play no
    part. An empty table gives no rows.
    """
    spark = docs.sparkSession
    at = ring(shards, nodes)
    places = [p for p, _ in at]
    table = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(at)], "arc long, home long")
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct().withColumn("place", place_of(F.col("doc_id")))
    keys = cut(keys.withColumn("arc", _arc(F.col("place"), places)))
    counts = {r["arc"]: r["n"] for r in keys.groupBy("arc").agg(F.count("*").alias("n")).collect()}  # shards * nodes rows
    rows = quotas(counts, at, shards, capacity)
    whole = {arc for arc, lo, hi, _ in rows if hi - lo == counts[arc]}
    one = spark.createDataFrame([(a, s) for a, _, _, s in rows if a in whole], "arc long, shard long")
    cut_up = spark.createDataFrame([r for r in rows if r[0] not in whole], "arc long, lo long, hi long, shard long")
    straight = keys.join(F.broadcast(one), "arc")
    rank = F.row_number().over(Window.partitionBy("arc").orderBy("place", "doc_id")) - 1
    split = keys.join(F.broadcast(cut_up.select("arc").distinct()), "arc").withColumn("rank", rank).withColumnRenamed("arc", "a")
    split = split.join(F.broadcast(cut_up), (F.col("a") == cut_up["arc"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    both = straight.select("doc_id", "arc", "shard").unionByName(split.select("doc_id", F.col("a").alias("arc"), "shard"))
    return both.join(F.broadcast(table), "arc").select("doc_id", "home", "shard")


def _arc(col: Column, places: list[int]) -> Column:
    """The number of the first virtual node at or after a place, going round."""
    n = len(places)

    @F.arrow_udf("long")
    def find(p):
        import numpy as np
        import pyarrow as pa

        return pa.array(np.searchsorted(np.array(places, np.int64), p.to_numpy(zero_copy_only=False), side="left") % n)

    return find(col)


def brute_force(ids: list[int], shards: int, nodes: int, capacity: str = CAPACITY) -> dict[int, int]:
    """The rule itself, key by key, for tests."""
    at, keys = ring(shards, nodes), set(ids)
    cap, load, out = -(-len(keys) * Fraction(capacity) // shards), [0] * shards, {}
    places = [p for p, _ in at]
    first = lambda k: bisect_left(places, place(str(k))) % len(at)
    for k in sorted(keys, key=lambda k: (first(k), place(str(k)), k)):
        i = first(k)
        while load[at[i % len(at)][1]] >= cap:
            i += 1
        out[k] = at[i % len(at)][1]
        load[out[k]] += 1
    return out


def assign_sql(shards: int = SHARDS, nodes: int = NODES, capacity: str = CAPACITY) -> str:
    """DuckDB SQL for the rows of assign(): one recursive step for each meeting of an arc's keys with a node."""
    hexed = lambda x: f"('0x' || substr(md5({x}), 1, 15))::BIGINT"
    num, den = Fraction(capacity).as_integer_ratio()
    return f"""
WITH RECURSIVE ring AS (SELECT (row_number() OVER (ORDER BY place, shard) - 1)::BIGINT AS arc, place, shard FROM (SELECT {hexed("'shard-' || s || '#' || v")} AS place, s AS shard FROM range({shards}) a(s), range({nodes}) b(v))),
keys AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, {hexed("doc_id::VARCHAR")} AS place FROM keys),
k AS (SELECT doc_id, p.place, coalesce(arc, 0) AS arc FROM p ASOF LEFT JOIN ring ON p.place <= ring.place),
r AS (SELECT doc_id, arc, row_number() OVER (PARTITION BY arc ORDER BY place, doc_id) - 1 AS rank FROM k),
c AS (SELECT list(coalesce(n, 0) ORDER BY arc) AS cnt, list(shard ORDER BY arc) AS node FROM ring LEFT JOIN (SELECT arc, count(*) AS n FROM k GROUP BY arc) USING (arc)),
cap AS (SELECT ((count(*) * {num} + {den * shards} - 1) // {den * shards})::BIGINT AS cap FROM keys),
walk AS (
SELECT 0::BIGINT AS arc, 0::BIGINT AS k, cnt[1]::BIGINT AS left_, 0::BIGINT AS rank, list_transform(range({shards}), lambda i: cap) AS room, NULL::BIGINT AS shard, 0::BIGINT AS lo FROM c, cap
UNION ALL
SELECT CASE WHEN left_ = 0 THEN arc + 1 ELSE arc END, CASE WHEN left_ = 0 THEN 0 ELSE k + 1 END, CASE WHEN left_ = 0 THEN cnt[arc + 2] ELSE left_ - t END, CASE WHEN left_ = 0 THEN 0 ELSE rank + t END,
CASE WHEN left_ = 0 THEN room ELSE list_concat(room[1:s], [room[s + 1] - t], room[s + 2:]) END, CASE WHEN left_ > 0 THEN s END, rank
FROM (SELECT walk.*, cnt, node[(arc + k) % {shards * nodes} + 1] AS s, least(left_, room[node[(arc + k) % {shards * nodes} + 1] + 1]) AS t FROM walk, c) WHERE arc < {shards * nodes - 1} OR left_ > 0)
SELECT doc_id, ring.shard AS home, walk.shard FROM r JOIN ring USING (arc) JOIN walk ON walk.arc = r.arc AND walk.shard IS NOT NULL AND r.rank >= walk.lo AND r.rank < walk.rank
"""
