"""Exact n-gram Jaccard join by set relations, and the components of its links.

A set can only be linked if enough of its shingles stand in other sets, too. So the corpus is first counted: every
slice of texts sends its shingle hashes, by hash range, to the tasks that count them, and gets back how many of each
set's shingles are shared. What remains, the candidates, is counted once more among itself, and keeps its shared
shingles only, rarest first. Sets within the threshold share one of the first shingles of each, so only these
prefixes are indexed. An index list is the sets that share a shingle, in blocks by size band, with each set's
position in the list's order: blocks out of size range are skipped, and so are positions from which the overlap can't
be reached any more.

Relations between sets replace most comparisons. Equal sets are one class. In every list one set leads, the one with
the fewest shingles of its own; the others are compared with it, and its answer serves all sets linked to it, as only
reachability is asked. A list stays open while it holds sets of different components in reach that no leader has met;
open lists get more leaders each round, chosen evenly over their components. From the second round on, most pairs are
answered from the overlaps of both sets with a common earlier leader. A leader has met its whole list and leaves it,
so every list ends, no list is expanded into its pairs, and no link between different components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .wordhash import Words, mixed, FIRST, SECOND

N, SLICE = 5, 2 << 20
#: Hash ranges hold about so many shingles each, and there are 2 ** LEAST_BITS of them at least.
RANGE, LEAST_BITS = 4 << 20, 8
#: Times more leaders an open list gets each round.
MORE = 64
#: Ids and shingles are broadcast only up to this many bytes of counted rows: the driver holds several times that.
SENT_BYTES = 8 << 20


class Shingles:
    """Distinct shingle hashes of texts: text k has values bounds[k] to bounds[k + 1], sorted."""

    def __init__(self, texts: list[bytes], n: int):
        words = Words(texts, lower=True)
        left = words.left()
        h = np.zeros(words.n, np.uint64)
        size = np.zeros(words.n, np.uint64)
        counts = np.diff(words.bounds)
        # a text of fewer than n words is one shingle of all its words
        length = np.minimum(n, np.repeat(counts, counts))
        for k in range(n):
            use = (k < length) & (k < left)
            at = np.flatnonzero(use)
            h[at] = h[at] * FIRST + words.hash[at + k]
            size[at] += np.uint64(1)
        h = mixed(h ^ (size * SECOND))
        valid = left >= length
        parts = [np.unique(h[a:b][valid[a:b]]) for a, b in zip(words.bounds[:-1], words.bounds[1:])]
        self.bounds = np.cumsum([0, *map(len, parts)])
        self.values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def identities(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit values that identify each set."""
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(self.values * m), dtype=np.uint64)]) for m in (FIRST, SECOND)]
        return tuple(mixed(s[self.bounds[1:]] - s[self.bounds[:-1]]).view(np.int64) for s in sums)

    def chosen(self, keep: np.ndarray) -> None:
        """Leaves only the texts for which keep is true."""
        sizes = self.sizes()
        self.values = self.values[np.repeat(keep, sizes)]
        self.bounds = np.cumsum([0, *sizes[keep]])


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def range_bits(shingles: int) -> int:
    return max(LEAST_BITS, math.ceil(math.log2(max(1, shingles) / RANGE)))


def small(x: np.ndarray) -> bytes:
    """Counts in one byte each if they fit, in four if not."""
    return x.astype(np.uint8 if x.max(initial=0) < 256 else np.uint32).tobytes()


def counts_of(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == n else np.uint32).astype(np.int64)


def by_range(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, ranges that have values, their bounds in that order)."""
    ranges = (values >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(ranges, kind="stable")
    found, starts = np.unique(ranges[order], return_index=True)
    return order, found, np.append(starts, len(values))


def low_part(values: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits after a value's range."""
    return ((values >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def frequencies(blobs: list[bytes]) -> np.ndarray:
    """For each 32-bit value of all blobs, in how many places it stands. Values equal by chance only make a shingle look more frequent than it is."""
    values = np.frombuffer(b"".join(blobs), np.uint32)
    order = np.argsort(values, kind="stable")
    new = np.diff(values[order], prepend=values[order][:1] + np.uint32(1)) != 0
    runs = np.cumsum(new) - 1
    out = np.empty(len(values), np.int64)
    out[order] = np.bincount(runs)[runs]
    return out


def set_rows(texts: DataFrame, n: int) -> DataFrame:
    """(doc_id, size, s1, s2, shared) for every text: s1 and s2 identify its set, shared counts its shingles that other texts have, too."""
    spark = texts.sparkSession
    bits = range_bits((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6)
    cell = pa.schema([("slice", pa.int64()), ("range", pa.int64()), ("low", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("s1", pa.list_(pa.int64())), ("s2", pa.list_(pa.int64()))])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, 1, SLICE):
                sets = Shingles(batch.column(1).to_pylist(), n)
                sizes, (s1, s2) = sets.sizes(), sets.identities()
                ids = batch.column(0).to_pylist()
                name = hash((*ids, *s1.tolist()))  # of numbers only: the same in every process
                order, found, bounds = by_range(sets.values, bits)
                low, owner = low_part(sets.values, bits)[order], np.repeat(np.arange(len(ids)), sizes)[order]
                rows = [(name, int(r), low[a:b].tobytes(), small(np.bincount(owner[a:b], minlength=len(ids))), None, None, None, None) for r, a, b in zip(found, bounds[:-1], bounds[1:])]
                rows.append((name, name % (1 << bits), None, None, ids, sizes.tolist(), s1.tolist(), s2.tolist()))
                yield common.as_batch(rows, cell)

    def counted(table: pa.Table) -> pa.Table:
        low, counts = table["low"].to_pylist(), table["counts"].to_pylist()
        shared = np.concatenate([[0], np.cumsum(frequencies([x for x in low if x is not None]) > 1)])
        out, at = [], 0
        for values, own in zip(low, counts):
            if values is None:
                out.append(None)
                continue
            m = len(values) // 4
            own = np.frombuffer(own, np.uint8) if np.frombuffer(own, np.uint8).sum(dtype=np.int64) == m else np.frombuffer(own, np.uint32)
            ends = at + np.cumsum(own, dtype=np.int64)
            out.append(small(np.diff(shared[np.concatenate([[at], ends])])))
            at += m
        return table.drop_columns(["low"]).set_column(table.column_names.index("counts") - 1, "counts", pa.array(out, pa.binary()))

    def gathered(table: pa.Table) -> pa.Table:
        head = [r for r in table.select(["ids", "sizes", "s1", "s2"]).to_pylist() if r["ids"] is not None]
        total = np.zeros(len(head[0]["ids"]), np.int64)
        for x in table["counts"].to_pylist():
            if x is not None:
                total += counts_of(x, len(total))
        times = len(head)  # a slice that stands in the input several times
        return pa.table([pa.array(head[0][c] * times, pa.int64()) for c in ("ids", "sizes", "s1", "s2")] + [pa.array(np.tile(total // times, times))], ["doc_id", "size", "s1", "s2", "shared"])

    head = "ids array<long>, sizes array<long>, s1 array<long>, s2 array<long>"
    spread = texts.mapInArrow(cells, f"slice long, range long, low binary, counts binary, {head}")
    answers = spread.groupBy("range").applyInArrow(counted, f"slice long, range long, counts binary, {head}")
    return answers.groupBy("slice").applyInArrow(gathered, "doc_id long, size long, s1 long, s2 long, shared long")


def candidate_sets(texts: DataFrame, n: int, percent: int, shingles: int) -> DataFrame:
    """texts (doc_id, text, id: the s1 of the wanted set) -> (id, size, own, set) of those that may be linked among themselves.

    own counts the shingles that no other set has; set has the rest as bytes, rarest first.
    """
    bits = range_bits(shingles)
    cell = pa.schema([("slice", pa.int64()), ("range", pa.int64()), ("low", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("values", pa.binary())])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, 1, SLICE):
                sets = Shingles(batch.column(1).to_pylist(), n)
                ids = batch.column(2).to_numpy()
                keep = sets.identities()[0] == ids
                sets.chosen(keep)
                ids = ids[keep].tolist()
                if not ids:
                    continue
                name = hash((*ids,))
                order, found, bounds = by_range(sets.values, bits)
                low = low_part(sets.values, bits)[order]
                rows = [(name, int(r), low[a:b].tobytes(), None, None, None) for r, a, b in zip(found, bounds[:-1], bounds[1:])]
                rows.append((name, name % (1 << bits), None, ids, sets.sizes().tolist(), sets.values.tobytes()))
                yield common.as_batch(rows, cell)

    def counted(table: pa.Table) -> pa.Table:
        low = table["low"].to_pylist()
        found, out, at = np.minimum(frequencies([x for x in low if x is not None]), 255).astype(np.uint8), [], 0
        for values in low:
            out.append(None if values is None else found[at : at + len(values) // 4].tobytes())
            at += 0 if values is None else len(values) // 4
        return table.set_column(table.column_names.index("low"), "low", pa.array(out, pa.binary()))

    def gathered(table: pa.Table) -> pa.Table:
        head = next(r for r in table.select(["ids", "sizes", "values"]).to_pylist() if r["ids"] is not None)
        values = np.frombuffer(head["values"], np.uint64)
        answers = dict((r, x) for r, x in zip(table["range"].to_pylist(), table["low"].to_pylist()) if x is not None)
        order, found, _ = by_range(values, bits)
        count = np.empty(len(values), np.uint8)
        count[order] = np.frombuffer(b"".join(answers[r] for r in found.tolist()), np.uint8)
        rows, at = [], 0
        for key, size in zip(head["ids"], head["sizes"]):
            own, often = values[at : at + size], count[at : at + size]
            at += size
            shared = own[often > 1]
            if 100 * len(shared) >= percent * size:
                rows.append((key, size, size - len(shared), shared[np.lexsort((shared, often[often > 1]))].tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["id", "size", "own", "set"])

    head = "ids array<long>, sizes array<long>, values binary"
    spread = texts.mapInArrow(cells, f"slice long, range long, low binary, {head}")
    answers = spread.groupBy("range").applyInArrow(counted, f"slice long, range long, low binary, {head}")
    return answers.groupBy("slice").applyInArrow(gathered, "id long, size int, own int, set binary").dropDuplicates(["id"])


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, id, size, own, at): the shared shingles of each set's prefix with their positions, its own ones standing before them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, owns = (batch.column(k).to_numpy() for k in range(3))
            # a set within the threshold shares at least percent of its shingles
            first = sizes - -(-percent * sizes.astype(np.int64) // 100) + 1 - owns
            values = [np.frombuffer(x, np.uint64)[:k] for x, k in zip(batch.column(3).to_pylist(), first.tolist())]
            at = [o + np.arange(len(v)) for o, v in zip(owns, values)]
            k = np.repeat(np.arange(len(ids)), [len(v) for v in values])
            if len(k):
                yield pa.RecordBatch.from_arrays([signed(np.concatenate(values)), pa.array(ids[k]), pa.array(sizes[k]), pa.array(owns[k]), pa.array(np.concatenate(at).astype(np.int32))], ["shingle", "id", "size", "own", "at"])

    return sets.select("id", "size", "own", "set").mapInArrow(work, "shingle long, id long, size int, own int, at int")


def reachable(x: str, y: str, percent: int) -> Column:
    """Whether two index entries can still belong to sets within the threshold: sizes in range, and enough shingles from both positions on."""
    m, n = F.col(f"{x}.size"), F.col(f"{y}.size")
    most = F.least(m - F.col(f"{x}.at"), n - F.col(f"{y}.at"))
    # 100 i >= percent (m + n - i)  <=>  (100 + percent) i >= percent (m + n)
    return (100 * F.least(m, n) >= percent * F.greatest(m, n)) & ((100 + percent) * most.cast("long") >= percent * (m + n).cast("long"))


def early(percent: int) -> Column:
    """Whether an entry can be the smaller set of a pair in reach; every pair in reach has such an entry."""
    return (100 + percent) * (F.col("size") - F.col("at")).cast("long") >= 2 * percent * F.col("size").cast("long")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (x, y) -> (x, y, m, n, p, q, both): sizes, how many shingles of each are shared with any set, and the size of the intersection."""
    columns = ["id", "size", "own", "set"]
    sided = common.met(common.met(pairs.select("x", "y"), sets.select(columns).toDF("y", "n", "oy", "sy"), "y"), sets.select(columns).toDF("x", "m", "ox", "sx"), "x")
    sided = sided.select("x", "y", "m", "n", (F.col("m") - F.col("ox")).alias("p"), (F.col("n") - F.col("oy")).alias("q"), "sx", "sy")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = []
            for a, b in zip(batch.column(6), batch.column(7)):
                u, v = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both.append(len(np.intersect1d(u, v, assume_unique=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(both, pa.int32())], ["x", "y", "m", "n", "p", "q", "both"])

    return sided.mapInArrow(work, "x long, y long, m int, n int, p int, q int, both int")


def linked(percent: int, both: str = "both") -> Column:
    return 100 * F.col(both).cast("long") >= percent * (F.col("m") + F.col("n") - F.col(both)).cast("long")


def with_leaders(lists: DataFrame, turn: int, percent: int) -> DataFrame:
    """The entries of open lists, with whether each leads this turn: one entry a list in the first, then MORE times more each turn."""
    own = lists.groupBy("shingle", "component").agg(F.count("*").alias("c"), F.count_if(early(percent)).alias("k"), F.min(F.struct((F.col("own") / F.col("size")).alias("rank"), "id")).alias("best"))
    per = own.groupBy("shingle").agg(F.count("*").alias("parts"), F.min("best").alias("best"), (F.sum("c") * F.sum("k") - F.sum(F.col("c") * F.col("k"))).alias("open"))
    per = per.filter("open > 0").select("shingle", "parts", F.col("best.id").alias("first"))
    if turn == 0:
        return common.met(lists, per, "shingle").withColumn("leads", F.col("id") == F.col("first")).drop("parts", "first")
    # a component's entries are led by an equal share of the leaders, so an entry that stands alone leads early
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit(turn)), 11) / float(1 << 53)
    leads = draw * F.col("c") * F.col("parts") < float(MORE) ** turn
    entries = common.met(common.met(lists, own.select("shingle", "component", "c"), ["shingle", "component"]), per, "shingle")
    return entries.withColumn("leads", leads).drop("c", "parts", "first")


def led_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(x, y): every entry of a list with its leaders y, if they are in different components and in reach; blocks of a list out of size range are never met."""
    band = F.floor(F.log(F.col("size").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    entry = F.struct("id", "size", "at", "component", "leads")
    leaders = lists.filter("leads").select("shingle", entry.alias("e"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    both = common.met(lists.select("shingle", entry.alias("o"), band.alias("band")), leaders, ["shingle", "band"])
    both = both.filter("o.component <> e.component and (not o.leads or o.id < e.id)")
    return both.filter(reachable("o", "e", percent)).select(F.col("o.id").alias("x"), F.col("e.id").alias("y")).distinct()


def derived(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """pairs (x, y) with `yes`: whether they are linked by the overlaps of x and y with common earlier leaders; null if these don't decide it.

    With o(x) and o(y) shingles of a leader in x and y, l shingles of the leader shared at all, and p and q of x and y,
    the overlap of x and y is at least o(x) + o(y) - l and at most min(o(x), o(y)) + min(p - o(x), q - o(y)). Only the
    leader most like x and the one most like y are asked, so a pair makes two rows at most, however many leaders both have met.
    """
    facts = known.select(F.col("x").alias("id"), F.col("y").alias("leader"), F.col("both").alias("o"), F.col("q").alias("l"), F.col("m").alias("size"), F.col("p").alias("shared"))
    rest = ["leader", "o", "l", "size", "shared"]
    most_like = 1.0 * F.col("o") / (F.col("l") + F.col("shared") - F.col("o"))
    best = facts.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct(most_like.alias("like"), "leader")).alias("b")).select("id", *[F.col(f"b.{c}").alias(c) for c in rest])

    def by(side: str, other: str) -> DataFrame:
        one = best.toDF(side, "leader", f"o{side}", "l", f"n{side}", f"p{side}")
        two = facts.select(F.col("id").alias(other), "leader", F.col("o").alias(f"o{other}"), F.col("size").alias(f"n{other}"), F.col("shared").alias(f"p{other}"))
        return common.met(common.met(pairs, one, side), two, [other, "leader"]).select("x", "y", "l", "ox", "oy", "nx", "ny", "px", "py")

    bounds = by("x", "y").unionByName(by("y", "x"))
    low = F.col("ox") + F.col("oy") - F.col("l")
    high = F.least("ox", "oy") + F.least(F.col("px") - F.col("ox"), F.col("py") - F.col("oy"))
    bounds = bounds.groupBy("x", "y").agg(F.max(low).alias("low"), F.min(high).alias("high"), F.first("nx").alias("m"), F.first("ny").alias("n"))
    return common.met(pairs, bounds, ["x", "y"], "left").select("x", "y", F.when(linked(percent, "low"), True).when(~linked(percent, "high"), False).alias("yes"))


def relabelled(table: DataFrame, moved: DataFrame) -> DataFrame:
    """table with its component replaced by what moved (id, component) says."""
    return common.met(table, moved.toDF("component", "to"), "component", "left").withColumn("component", F.coalesce("to", "component")).drop("to")


def set_components(sets: DataFrame, percent: int) -> DataFrame:
    """sets (id, size, own, set) -> (id, component): the components of all links between them, for sets that are linked."""
    once = prefixes(sets, percent)
    shared = once.groupBy("shingle").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.max(early(percent)).alias("early")).filter("a < z and early").select("shingle")
    tables = common.Tables(sets.sparkSession, "lists")
    lists = tables.write(common.met(once, shared, "shingle", "left_semi").withColumn("component", F.col("id")))
    found: DataFrame | None = None
    facts: DataFrame | None = None
    turn = 0
    while True:
        lists = tables.write(with_leaders(lists, turn, percent))
        if lists.isEmpty():
            break
        pairs = led_pairs(lists, percent)
        if facts is None:
            measured = tables.write(overlaps(pairs, sets))
            links, facts = measured.filter(linked(percent)).select("x", "y"), measured
        else:
            state = tables.write(derived(pairs, facts, percent))
            measured = tables.write(overlaps(state.filter("yes is null"), sets))
            links, facts = measured.filter(linked(percent)).select("x", "y").unionByName(state.filter("yes").select("x", "y")), facts.unionByName(measured)
        lists = lists.filter("not leads").drop("leads")
        if not links.isEmpty():
            if found is not None:  # links between the components found so far
                for side in ("x", "y"):
                    links = common.met(links, found.toDF(side, "c"), side, "left").withColumn(side, F.coalesce("c", side)).drop("c")
            moved = components(links.toDF("a", "b"))
            lists = relabelled(lists, moved)
            if found is None:
                found = moved
            else:
                new = common.met(moved, found.select("id"), "id", "left_anti")
                found = tables.write(relabelled(found, moved).select("id", "component").unionByName(new))
        turn += 1
    return tables.last(found if found is not None else sets.sparkSession.createDataFrame([], "id long, component long"))


def similar_components(docs: DataFrame, n: int = N, percent: int = 75) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Shingles are runs of n lower-cased words; a text of fewer words is one shingle, a null or wordless text has none
    and is linked with nothing. Links: 100 * intersection >= percent * union. A null id is linked with nothing and
    has a null component_id. Rows that share an id are one place for reachability only if they have equal sets;
    further columns are ignored, an empty table gives no rows. docs is read twice and must give the same rows both times.
    """
    texts = texts_of(docs)
    rows = common.cut(set_rows(texts, n))
    key = ["size", "s1", "s2"]
    classes = common.cut(rows.filter("size > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.max("shared").alias("shared")))
    wanted = common.cut(classes.filter(100 * F.col("shared") >= percent * F.col("size")).select(F.col("rep").alias("doc_id"), F.col("s1").alias("id"), "size"))
    shingles = wanted.agg(F.sum("size")).first()[0] or 0
    chosen = texts.join(common.sized(wanted.select("doc_id", "id"), 32, SENT_BYTES), "doc_id").select("doc_id", "text", "id")
    sets = common.cut(candidate_sets(chosen, n, percent, shingles))
    found = set_components(sets, percent)

    # the smallest document of each component, then of each class that has several documents or links
    linked_classes = common.met(classes, found.withColumnRenamed("id", "s1"), "s1")
    least = linked_classes.groupBy("component").agg(F.min("rep").alias("least"))
    named = common.met(linked_classes, least, "component").select(*key, "least")
    alone = common.met(classes.filter("n > 1"), found.select(F.col("id").alias("s1")), "s1", "left_anti").select(*key, F.col("rep").alias("least"))
    out = rows.filter("doc_id is not null").join(named.unionByName(alone), key, "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
    return out.unionByName(rows.filter("doc_id is null").select("doc_id", F.col("size").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def keep_one(docs: DataFrame, n: int = N, percent: int = 75) -> DataFrame:
    """The rows of docs, columns unchanged, whose id is their component's smallest; of equal ids each row stays, and so do null ids."""
    found = similar_components(docs, n, percent).select("doc_id", "component_id")
    gone = common.cut(found.filter("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(common.sized(gone, 24, SENT_BYTES), "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


#: Every link and its reach, over whole texts.
ORACLE = r"""
with recursive word as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingle as (
  select doc_id, unnest(list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, greatest(len(w) - 4, 1) + 1)])) as s from word where len(w) > 0
), size as (
  select doc_id, count(*) as n from shingle group by doc_id
), pair as (
  select a.doc_id as a, b.doc_id as b, count(*) as i from shingle a join shingle b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2
), link as (
  select a, b from pair join size x on x.doc_id = a join size y on y.doc_id = b where 100 * i >= 75 * (x.n + y.n - i)
), reach(doc_id, c) as (
  select doc_id, doc_id from documents union select r.doc_id, l.b from reach r join link l on r.c = l.a
)
select d.doc_id, coalesce(any_value(s.n), 0) as n_shingles, min(r.c) as component_id
from documents d join reach r on r.doc_id = d.doc_id left join size s on s.doc_id = d.doc_id group by d.doc_id
"""
