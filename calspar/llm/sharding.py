"""Sharding by minimax contiguous partition.

Atomic groups (rows of equal text) are ordered by the hash of their text; shards are runs of this order. The smallest
feasible capacity is found by bisection with a greedy check: a run takes groups as long as they fit, and a group
above the capacity stands alone, as no capacity below it can hold it. Then the order is cut there.

The order is never fetched. It is read in ranges of the hash, first in equal ones, and the check is done twice: with
ranges that can't be parted, which bounds the capacity from above, and with ranges that can be parted anywhere,
which bounds it from below. Only the ranges in which a cut can lie between both are opened into smaller ones, until
they are single groups: then the capacity and the cuts are those of the groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The order starts in 2 ** CELL_BITS ranges, and a range is opened into 2 ** OPEN_BITS at a time. What reaches the driver at once
#: are the first ranges, then the parts of those that a cut can lie in: a number that depends on the shards alone.
CELL_BITS, OPEN_BITS = 16, 8


@dataclass(frozen=True)
class Atom:
    """A range of the order: the signed hashes from start on whose upper `bits` bits are the same."""

    start: int
    bits: int
    size: int
    groups: int

    @property
    def single(self) -> bool:
        return self.groups == 1


def reach(total: list[int], single: list[bool], at: int, capacity: int, fluid: bool) -> int:
    """The farthest place that one run from place `at` gets to; total: sums of the atoms before each. A single group above the capacity stands alone."""
    n = len(single)
    k = bisect_right(total, at + capacity) - 1  # the last atom border in reach
    if k >= n:
        return total[n]
    first = bisect_right(total, at) - 1  # the atom that `at` lies in
    if fluid and not single[k]:
        return at + capacity
    if k > first:
        return total[k]
    return total[first + 1] if single[first] and total[first] == at else at


def ends(total: list[int], single: list[bool], capacity: int, shards: int, fluid: bool) -> list[int]:
    """Where a greedy scan's runs end."""
    at, out = 0, []
    for _ in range(shards):
        at = reach(total, single, at, capacity, fluid)
        out.append(at)
    return out


def least_capacity(sizes: list[int], single: list[bool], shards: int, fluid: bool = False) -> int:
    """The smallest capacity with which `shards` runs reach the end; atoms that aren't single can't be parted, or, if fluid, anywhere."""
    total = [0, *accumulate(sizes)]
    low, high = -(-(total[-1] - sum(sorted((s for s, x in zip(sizes, single) if x), reverse=True)[: shards - 1])) // shards) if shards > 1 else 0, total[-1]
    low = max(low, 1)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if ends(total, single, middle, shards, fluid)[-1] >= total[-1] else (middle + 1, high)
    return low


def open_atoms(atoms: list[Atom], shards: int) -> list[int]:
    """Which atoms of several groups a cut of the best partition can lie in; none: the atoms decide it."""
    sizes, single = [a.size for a in atoms], [a.single for a in atoms]
    total = [0, *accumulate(sizes)]
    low, high = least_capacity(sizes, single, shards, True), least_capacity(sizes, single, shards)
    nearest = ends(total, single, low, shards, False)
    farthest = ends(total, single, high, shards, True)
    wanted = set()
    for a, b in zip(nearest, farthest):
        first, last = bisect_right(total, a) - 1, bisect_left(total, b)
        wanted.update(k for k in range(max(first, 0), min(last + 1, len(atoms))) if not single[k])
    return sorted(wanted)


def cut_points(sizes: list[int], shards: int) -> list[int]:
    """Ends of the runs, as numbers of groups: none above the least capacity but single groups, each as near to an even share of what is left as that allows."""
    n, single = len(sizes), [True] * len(sizes)
    if not n:
        return [0] * shards
    capacity = least_capacity(sizes, single, shards)
    total = [0, *accumulate(sizes)]
    least = [n]  # least[k]: the first group from which k runs get to the end
    for _ in range(shards):
        k = bisect_left(total, total[least[-1]] - capacity)
        least.append(max(0, min(k, least[-1] - 1)))
    out, at = [], 0
    for left in range(shards, 0, -1):
        most = bisect_left(total, reach(total, single, total[at], capacity, False)) if at < n else n
        most = max(most, bisect_right(total, total[most]) - 1)
        aim = min(total[at] + max(capacity // 2, -(-(total[n] - total[at]) // left)), total[n])
        near = bisect_left(total, aim)
        if near > at + 1 and aim - total[near - 1] < total[min(near, n)] - aim:
            near -= 1
        at = min(max(near, least[left - 1], at), most)
        out.append(at)
    return out


def ranges(groups: DataFrame, bits: int) -> DataFrame:
    """(start, bits, size, groups) of the ranges of groups (group, size) whose hashes share their upper bits."""
    start = F.shiftleft(F.shiftright("group", 64 - bits), 64 - bits) if bits < 64 else F.col("group")
    return groups.groupBy(start.alias("start")).agg(F.sum("size").alias("size"), F.count("*").alias("groups")).select("start", F.lit(bits).alias("bits"), "size", "groups")


def best_cuts(groups: DataFrame, shards: int) -> list[int]:
    """The hashes with which the second and later shards begin (the largest hash plus 1 if a shard is empty), over groups (group, size), one row each."""

    def fetched(df: DataFrame) -> list[Atom]:
        return [Atom(r["start"], r["bits"], r["size"], r["groups"]) for r in df.collect()]

    atoms = sorted(fetched(ranges(groups, CELL_BITS)), key=lambda a: a.start)
    while opened := open_atoms(atoms, shards):
        parts = None
        for bits in sorted({atoms[k].bits for k in opened}):
            starts = [atoms[k].start for k in opened if atoms[k].bits == bits]
            own = F.shiftleft(F.shiftright("group", 64 - bits), 64 - bits)
            found = ranges(groups.filter(own.isin(starts)), min(64, bits + OPEN_BITS))
            parts = found if parts is None else parts.unionByName(found)
        chosen = set(opened)
        atoms = sorted([a for k, a in enumerate(atoms) if k not in chosen] + fetched(parts), key=lambda a: a.start)
    # no cut lies inside what is still of several groups: such an atom counts as one group
    return [atoms[k].start if k < len(atoms) else 1 << 63 for k in cut_points([a.size for a in atoms], shards)[:-1]]


def shards_of(rows: DataFrame, shards: int = 16) -> DataFrame:
    """rows (doc_id, size, group: 64-bit hash) with shard and slot: equal groups together, sizes near equal, slots gapless from 0.

    rows is read several times; give a checkpoint. A group larger than the capacity has a shard of its own.
    """
    groups = common.cut(rows.groupBy("group").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    starts = best_cuts(groups.select("group", "size"), shards)
    shard: Column = F.lit(0)
    for k, start in enumerate(starts):
        shard = shard + (F.when(F.col("group") >= start, 1).otherwise(0) if start < 1 << 63 else F.lit(0))
    # a cell of many rows (a large group of copies) is numbered in several parts, so that no task sorts it alone
    cell = F.shiftright("group", 64 - CELL_BITS).cast("int")
    cells = groups.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n"))
    count = groups.agg(F.sum("n")).first()[0] or 0
    part_rows = max(256, 2 * count >> CELL_BITS)
    parts = cells.filter(F.col("n") > part_rows).select("cell", F.ceil(F.col("n") / part_rows).alias("parts"))  # fewer than half of all cells
    rows = rows.withColumn("cell", cell).join(F.broadcast(parts), "cell", "left").withColumn("shard", shard)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1)))).drop("parts")
    # at most 2 ** CELL_BITS + shards + count / part_rows rows, that is 1.5 * 2 ** CELL_BITS and a few
    counts = rows.groupBy("shard", "cell", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "cell", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "cell", "part").orderBy("doc_id", "size")
    rows = rows.withColumn("nth", F.row_number().over(inside) - 1)
    out = rows.join(F.broadcast(bases), ["shard", "cell", "part"])
    return out.withColumn("slot", (F.col("base") + F.col("nth")).cast("long")).drop("cell", "part", "base", "nth")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 1. A null text counts as empty and shares a group with empty texts; a null
    id and repeated rows are rows like any other; further columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
    )
    done = shards_of(common.cut(rows), shards)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
