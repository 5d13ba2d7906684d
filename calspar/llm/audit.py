"""How filters act on each other, from sorted posting lists of the rows that each one fails.

Rows get numbers in the order in which they are stored. For each part (a source) and each range of numbers there is one
posting row: the sorted numbers of the rows failing each filter, and of those with each label. Unions and differences
are found list by list with galloping merges: the shorter list is looked up in the longer one in leaps that double,
so long stretches without a common number are passed over. Ranges don't meet, so sizes found in each are added up.

What a filter removes after others is the size of its list less their union; everything an audit says, for any order of
the filters, follows from the sizes of the unions of their subsets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
UPPER = bytes(range(65, 91))
MARKS = b"#$%&*|"
#: Rows of a range at most are 2 ** RANGE_BITS.
RANGE_BITS = 16


def text_failures(text: str) -> int:
    """Which of the filters A to D the text fails, as bits."""
    data = text.encode()
    words = data.split()  # parts at the six ASCII white spaces
    upper = len(data) - len(data.translate(None, UPPER))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * upper > 2 * len(text)) << 2 | (len(data.translate(None, MARKS)) < len(data)) << 3


FACTS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("fails", pa.int32()), ("digest", pa.binary())])


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, fails: bits of A to D, digest of the text) of every row."""

    def work(doc_id: int | None, part: str, text: str) -> Iterator[tuple]:
        yield doc_id, part, text_failures(text), hashlib.blake2b(text.encode(), digest_size=16).digest()

    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(part_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    return rows.mapInArrow(common.by_rows(work, FACTS), "doc_id long, part string, fails int, digest binary")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic: booleans) of every row.

    E: the same text stands in a row of a smaller id anywhere; a null id is neither smaller nor larger than another.
    """
    rows = common.cut(facts(docs))
    # cut, so that the join deals both sides anew and can split the rows of a text that very many share
    first = common.cut(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    marked = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    own = [F.getbit("fails", F.lit(k)) == 1 for k in range(4)]
    out = rows.join(common.sized(first, 64), "digest", "left").join(marked, "doc_id", "left")
    no = F.lit(False)
    return out.select("part", *[c.alias(FILTERS[k]) for k, c in enumerate(own)], F.coalesce(F.col("doc_id") > F.col("first"), no).alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def postings(rows: DataFrame, lists: list[str]) -> DataFrame:
    """(part, range, n, one sorted list of row numbers for each of `lists`): rows has a part and a boolean for each list."""
    numbered = common.cut(rows.withColumn("number", F.monotonically_increasing_id()))
    place = F.shiftright("number", RANGE_BITS).alias("range")
    # a number inside its range takes an int
    inside = (F.col("number") - F.shiftleft(F.shiftright("number", RANGE_BITS), RANGE_BITS)).cast("int")
    return numbered.groupBy("part", place).agg(F.count("*").alias("n"), *[F.array_sort(F.collect_list(F.when(F.col(c), inside))).alias(c) for c in lists])


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which numbers of `short` stand in `long`, both sorted: leaps that double from the last place on, then halving inside the last leap."""
    at = np.zeros(len(short), dtype=bool)
    place, n = 0, len(long)
    step = max(1, len(short) // 64)  # a stretch of short is looked up at once between the leaps for its ends
    for a in range(0, len(short), step):
        stretch = short[a : a + step]
        leap = 1
        while place + leap < n and long[place + leap] <= stretch[-1]:
            leap *= 2
        end = min(place + leap + 1, n)
        found = place + np.searchsorted(long[place:end], stretch)
        at[a : a + step] = long[np.minimum(found, n - 1)] == stretch if n else False
        place = min(int(found[-1]), max(n - 1, 0))
    return at


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The numbers of a that aren't in b, both sorted."""
    if len(a) <= len(b):
        return a[~gallop(a, b)]
    gone = b[gallop(b, a)]
    return np.delete(a, np.searchsorted(a, gone))


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    new = difference(b, a)
    return np.insert(a, np.searchsorted(a, new), new) if len(new) else a


def subset_sizes(lists: list[np.ndarray], others: list[np.ndarray]) -> list[list[int]]:
    """For each subset of the lists (by bits) the size of its union, then of the union within each of the other lists."""
    unions = [np.empty(0, dtype=np.int32)]
    for subset in range(1, 1 << len(lists)):
        top = subset.bit_length() - 1
        unions.append(union(unions[subset ^ (1 << top)], lists[top]))
    return [[len(u) for u in unions], *[[len(o) - len(difference(o, u)) for u in unions] for o in others]]


SIZES = pa.schema([("part", pa.string()), ("n", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("union", "good", "toxic")]])


def part_sizes(posted: DataFrame) -> DataFrame:
    """(part, subset, n, all, good, toxic): rows of the part, and sizes of each subset's union, over all ranges."""

    def work(part: str, n: int, *lists: list[int]) -> Iterator[tuple]:
        own = [np.array(x, dtype=np.int32) for x in lists]
        yield part, n, *subset_sizes(own[: len(FILTERS)], own[len(FILTERS) :])

    sized = posted.select("part", "n", *FILTERS, "good", "toxic").mapInArrow(common.by_rows(work, SIZES), "part string, n long, union array<long>, good array<long>, toxic array<long>")
    each = sized.select("part", "n", F.posexplode(F.arrays_zip("union", "good", "toxic")).alias("subset", "x"))
    return each.groupBy("part", "subset").agg(F.sum("n").alias("n"), F.sum("x.union").alias("all"), F.sum("x.good").alias("good"), F.sum("x.toxic").alias("toxic"))


def orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, number of the step's filter, subset of those before it) of all orders."""
    return [("".join(FILTERS[f] for f in p), k + 1, p[k], sum(1 << f for f in p[:k])) for p in permutations(range(len(FILTERS))) for k in range(len(FILTERS))]


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text counts as empty, a null part as ''. Repeated rows and ids are rows of their own; a document with several
    labels is good or toxic if any of them says so; labels without a document don't count. Further columns are ignored,
    an empty table gives no rows.
    """
    sizes = part_sizes(postings(failures(docs, labels), [*FILTERS, "good", "toxic"]))
    table = sizes.groupBy("part").agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("subset", F.struct("all", "good", "toxic")))).alias("u"))  # 32 subsets
    at = lambda subset, what: F.element_at("u", subset)[what]
    every = (1 << len(FILTERS)) - 1
    weighted = [(f, s, factorial(bin(s).count("1")) * factorial(len(FILTERS) - 1 - bin(s).count("1"))) for f in range(len(FILTERS)) for s in range(every + 1) if not s >> f & 1]
    for f in range(len(FILTERS)):
        table = table.withColumn(f"shapley{f}", sum((w * (at(F.lit(s | 1 << f), "all") - at(F.lit(s), "all")) for g, s, w in weighted if g == f), F.lit(0)))
    plain = table.select("part", "n", "u", F.array(*[f"shapley{f}" for f in range(len(FILTERS))]).alias("shapley"))
    # the steps are 600 rows, for every part
    all_steps = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(row, ("filter_order", "step", "f", "before"))]) for row in orders()])
    rows = plain.select("*", F.inline(all_steps))
    only = F.expr("shiftleft(1, f)")
    after = F.col("before") + only
    removed = at(after, "all") - at(F.col("before"), "all")
    return rows.select(
        "part", "filter_order", "step", (F.col("n") - at(after, "all")).alias("kept"), removed.alias("removed"), (at(only, "all") - removed).alias("redundant"),
        (at(F.lit(every), "all") - at(F.lit(every) - only, "all")).alias("unique_fails"), (at(after, "good") - at(F.col("before"), "good")).alias("good_lost"),
        (at(after, "toxic") - at(F.col("before"), "toxic")).alias("toxic_lost"), F.element_at("shapley", F.col("f") + 1).alias("shapley"),
    )


ORACLE = f"""
with said as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels where doc_id is not null group by doc_id
), texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents
), worded as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words, min(doc_id) over (partition by text) as first from texts
), rows as (
select part, (len(words) < 200)::int + 2 * (100 * list_unique(words) < 50 * len(words))::int + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::int
  + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(w.doc_id > first, false)::int as fails, coalesce(good, false) as good, coalesce(toxic, false) as toxic
from worded w left join said s on s.doc_id = w.doc_id
), counted as (select part, fails, count(*) as n, count(*) filter (good) as g, count(*) filter (toxic) as t from rows group by part, fails
), steps as (select * from (values {", ".join(f"('{o}', {k}, {1 << f}, {b})" for o, k, f, b in orders())}) v(filter_order, step, f, before)
), seen as (
select part, filter_order, step, f, sum(n) filter (fails & (before | f) = 0) as kept, sum(n) filter (fails & f <> 0 and fails & before = 0) as removed, sum(n) filter (fails & f <> 0 and fails & before <> 0) as redundant,
  sum(n) filter (fails = f) as unique_fails, sum(g) filter (fails & f <> 0 and fails & before = 0) as good_lost, sum(t) filter (fails & f <> 0 and fails & before = 0) as toxic_lost
from counted, steps group by part, filter_order, step, f)
select part, filter_order, cast(step as integer) as step, {", ".join(f"cast(coalesce({c}, 0) as bigint) as {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  cast(coalesce(sum(removed) over (partition by part, f), 0) as bigint) as shapley from seen"""
