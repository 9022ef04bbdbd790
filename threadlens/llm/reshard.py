"""Resharding by a minimum-cost flow.

From the sizes of the old shards and the capacities of the new ones a flow network
is solved: each old shard sends its bytes to new shards, bytes that stay cost
nothing and bytes that move cost one each. The flow says how much each old shard
hands to each new one; blocks (hash ranges of texts within an old shard) are dealt
so that they follow it. Shards that gain or lose blocks are rewritten, others are
left as they are.

Equal texts lie in one block and so stay together. A block above a quarter of a
shard's capacity (a group of copies that large) is split by ``doc_id``, because
shards of near equal size are the law that holds.

Defined results: a null or empty text counts one byte; rows of equal ``doc_id``
are kept and ordered by their texts; null ids come first; an empty table gives no
rows. Further columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, partitions, shared_folder, table

#: Blocks of an old shard.
BLOCKS = 256


def cheapest_flow(supply: list[int], capacity: list[int], cost) -> list[list[int]]:
    """The flow from each source to each sink of least ``sum(flow * cost(i, j))``.

    Successive shortest paths in the residual network; supplies must fit the capacities.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards cannot hold all bytes")
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        # Distances from all sources with bytes left; backward arcs undo earlier flow.
        far = float("inf")
        dist_s, dist_t = [0 if x else far for x in left], [far] * m
        via_s, via_t = [-1] * n, [-1] * m
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist_s[i] + cost(i, j) < dist_t[j]:
                        dist_t[j], via_t[j], changed = dist_s[i] + cost(i, j), i, True
                    if flow[i][j] and dist_t[j] - cost(i, j) < dist_s[i]:
                        dist_s[i], via_s[i], changed = dist_t[j] - cost(i, j), j, True
        end = min((j for j in range(m) if room[j]), key=lambda j: dist_t[j])
        path, j = [], end
        while True:
            i = via_t[j]
            path.append((i, j, 1))
            if via_s[i] < 0:
                break
            path.append((i, via_s[i], -1))
            j = via_s[i]
        amount = min([left[i], room[end], *(flow[a][b] for a, b, sign in path if sign < 0)])
        for a, b, sign in path:
            flow[a][b] += sign * amount
        left[i] -= amount
        room[end] -= amount
    return flow


def dealt(blocks: dict[tuple, int], flow: list[list[int]], home: dict) -> dict[tuple, int]:
    """The new shard of each block ``(old, ...)``: large ones first, to the transfer with most bytes left."""
    out: dict[tuple, int] = {}
    olds = sorted(home, key=home.get)
    for old, own in zip(olds, flow, strict=True):
        open_bytes = list(own)
        for block in sorted((b for b in blocks if b[0] == old), key=lambda b: (-blocks[b], b)):
            j = max(range(len(open_bytes)), key=lambda k: (open_bytes[k], k == home[old], -k))
            open_bytes[j] -= blocks[block]
            out[block] = j
    return out


@dataclass
class Plan:
    """Which blocks go where.

    ``parts`` gives the pieces of a block that had to be split, by text; ``torn`` the
    first piece and the pieces of a text that is too large itself, by document.
    """

    shard_of: dict[tuple[int, int, int], int]
    parts: dict[tuple[int, int], int]
    torn: dict[tuple[int, int, int], tuple[int, int]]
    moved_bytes: int
    affected: list[int]


def _block() -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), "text"), F.lit(BLOCKS)).cast("int")


def planned(sized: DataFrame, n_new: int) -> Plan:
    """Plan for rows with ``old, block, size, doc_id, text``; per block one sum reaches the driver."""
    total_of = lambda df, *by: {tuple(r)[:-1]: r.b for r in df.groupBy(*by).agg(F.sum("size").alias("b")).collect()}
    whole = total_of(sized, "old", "block")
    total = sum(whole.values())
    capacity = [total // n_new + (k < total % n_new) for k in range(n_new)]
    bound = max(1, total // n_new // 4)
    parts = {b: -(-4 * size // bound) for b, size in whole.items() if size > bound}
    sizes = {(*b, 0): size for b, size in whole.items() if b not in parts}
    torn: dict[tuple[int, int, int], tuple[int, int]] = {}
    if parts:
        # Copies of one text that fill more than the bound: fewer than four for each new shard.
        heavy = sized.where(_in(parts)).groupBy("old", "block", _text().alias("key")).agg(F.sum("size").alias("b"))
        next_part = dict(parts)
        for r in heavy.where(F.col("b") > bound).orderBy("old", "block", "key").collect():
            pieces = -(-4 * r.b // bound)
            torn[r.old, r.block, r.key] = (next_part[r.old, r.block], pieces)
            next_part[r.old, r.block] += pieces
        split = sized.where(_in(parts)).withColumn("part", _part(parts, torn))
        sizes |= total_of(split, "old", "block", "part")
    olds = sorted({b[0] for b in sizes})
    home = {old: k for k, old in enumerate(olds)}
    supply = [sum(s for b, s in sizes.items() if b[0] == old) for old in olds]
    flow = cheapest_flow(supply, capacity, lambda i, j: int(i != j))
    shard_of = dealt(sizes, flow, home)
    moved = {b for b, j in shard_of.items() if home[b[0]] != j}
    affected = sorted({shard_of[b] for b in moved} | {home[b[0]] for b in moved if home[b[0]] < n_new} | set(range(len(olds), n_new)))
    return Plan(shard_of, parts, torn, sum(sizes[b] for b in moved), affected)


def _in(blocks) -> Column:
    return F.concat_ws(":", "old", "block").isin([f"{o}:{b}" for o, b in blocks])


def _text() -> Column:
    return F.xxhash64(F.lit("part"), "text")


def _part(parts: dict[tuple[int, int], int], torn: dict[tuple[int, int, int], tuple[int, int]]) -> Column:
    """The piece of its block that a row is in: equal texts share one, unless the text is torn."""
    out = F.lit(0)
    for (old, block), n in parts.items():
        out = F.when((F.col("old") == old) & (F.col("block") == block), F.pmod(_text(), F.lit(n)).cast("int")).otherwise(out)
    for (old, block, key), (first, n) in torn.items():
        this = (F.col("old") == old) & (F.col("block") == block) & (_text() == key)
        out = F.when(this, first + F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).otherwise(out)
    return out


def resharded(docs: DataFrame, old: Column, n_new: int) -> tuple[DataFrame, Plan]:
    """``doc_id, text, size, shard, slot`` of all rows, read from the rewritten shards, and the plan.

    ``old`` gives the old shard (an int) of a row.
    """
    spark = docs.sparkSession
    sized = docs.select(
        "doc_id", "text", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        old.cast("int").alias("old"), _block().alias("block"))
    plan = planned(sized, n_new)
    places = spark.createDataFrame(
        [(*b, j) for b, j in plan.shard_of.items()], "old int, block int, part int, shard int")
    # One row a block, BLOCKS for each old shard at most.
    placed = sized.withColumn("part", _part(plan.parts, plan.torn)).join(F.broadcast(places), ["old", "block", "part"])
    # Slots count through slices of a shard, and within a slice by id.
    n_slices = partitions(spark)
    placed = placed.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_slices)).cast("int"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("shard", "slice").agg(F.count("*").alias("n")).select(
        "shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("doc_id", "text"))
    rows = placed.select("doc_id", "text", "size", "shard", "slice").withColumn("rank", rank).join(
        bases, ["shard", "slice"]).select("doc_id", "text", "size", (F.col("base") + F.col("rank") - 1).alias("slot"), "shard")
    path = shared_folder(spark, "shards")
    kind = docs.schema["doc_id"].dataType.simpleString()
    affected = rows.where(F.col("shard").isin(plan.affected))
    affected.write.partitionBy("shard").parquet(path)
    back = spark.read.schema(f"doc_id {kind}, text string, size long, slot long, shard int").parquet(path)
    return back.unionByName(rows.where(~F.col("shard").isin(plan.affected))), plan


def op9_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents from six shards by text hash to eight of near equal bytes."""
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    rows, _ = resharded(docs, F.pmod(F.xxhash64("text"), F.lit(6)), 8)
    return rows.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op9_resharding": op9_resharding}
SQL: dict[str, str] = {}
