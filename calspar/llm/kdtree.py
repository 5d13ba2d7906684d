"""Exact top-k search by inner product: a KD-tree for each shard of rows, searched best box first.

Rows are gathered into shards of bounded size where they are read, without a shuffle, and put into the order of a
KD-tree: each node splits its rows at the median of its widest dimension, down to small leaves, and every node has a tight
box. No point of a box has an inner product with a query above the sum of the larger of q * low and q * high.

Every query first searches its own shard, which gives it a score that the last of its answers has at least. This kth
score goes with the query to all other shards: below it boxes are not opened and rows not sent on. Inside a shard
boxes are opened level by level, those that no query can use are dropped with all below them, and each query visits the
leaves that remain in the order of their bounds, in waves that double; what a wave finds raises the kth score for the
next. A box whose bound equals the kth score is opened only if it holds a smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, whole

#: Rows of a shard and of a leaf at most; home shards whose queries meet another shard in one task.
SHARD_ROWS, LEAF_ROWS, BLOCKS = 65_536, 256, 16


@dataclass
class Tree:
    """A shard in tree order. ids: null ones are the largest long. Nodes lie in heap order, levels from the root on."""

    vectors: np.ndarray
    ids: np.ndarray
    bounds: list[np.ndarray]  # per level the first rows of its nodes, and the end
    low: list[np.ndarray]
    high: list[np.ndarray]
    least: list[np.ndarray]  # per level the smallest id of each node


def node_starts(n: int, leaf: int) -> list[np.ndarray]:
    """Per level where nodes begin: every node of a level is halved until all have `leaf` rows at most."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max(initial=0) > leaf:
        old = levels[-1]
        levels.append(np.concatenate([np.column_stack([old[:-1], (old[:-1] + old[1:]) // 2]).ravel(), old[-1:]]))
    return levels


def tree_order(vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS) -> np.ndarray:
    """The rows' order in the tree: at each node the smaller half of its widest dimension first, equal values by id."""
    order = np.argsort(ids, kind="stable")
    for level in node_starts(len(ids), leaf)[:-1]:
        for a, b in zip(level[:-1], level[1:]):
            part = order[a:b]
            own = vectors[part]
            widest = np.argmax(own.max(0) - own.min(0)) if own.size else 0
            if own.size:
                order[a:b] = part[np.lexsort((ids[part], own[:, widest]))]
    return order


def tree_of(vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS) -> Tree:
    """The tree over rows that are in tree order already."""
    bounds = node_starts(len(ids), leaf)
    low, high, least = ([f.reduceat(v, bounds[-1][:-1])] for f, v in ((np.minimum, vectors), (np.maximum, vectors), (np.minimum, ids)))
    for _ in bounds[:-1]:
        for table, f in ((low, np.minimum), (high, np.maximum), (least, np.minimum)):
            table.insert(0, f(table[0][0::2], table[0][1::2]))
    return Tree(vectors, ids, bounds, low, high, least)


@dataclass
class Best:
    """The best answers so far of each query, best first; free places have the least score and the largest id. Nothing is taken that doesn't come before (limit, limit_id), the last answer known from elsewhere."""

    scores: np.ndarray
    ids: np.ndarray
    limit: np.ndarray
    limit_id: np.ndarray

    @staticmethod
    def none(queries: int, k: int) -> Best:
        return Best(np.full((queries, k), whole.LEAST), np.full((queries, k), whole.MOST), np.full(queries, whole.LEAST), np.full(queries, whole.MOST))

    def beaten(self, query: np.ndarray, score: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        """Whether (score, id) would displace a query's last answer."""
        last, limit = self.scores[query, -1], self.limit[query]
        own = (score > last) | ((score == last) & (least_id < self.ids[query, -1]))
        return own & ((score > limit) | ((score == limit) & (least_id < self.limit_id[query])))

    def take(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        k = self.scores.shape[1]
        some = np.unique(query)
        q = np.concatenate([np.repeat(some, k), query])
        s, i = np.concatenate([self.scores[some].ravel(), score]), np.concatenate([self.ids[some].ravel(), ids])
        order = np.lexsort((i, ~s, q))  # ~s falls as s rises, without overflow
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, some)
        nth = np.arange(k)[None, :] + first[:, None]
        self.scores[some], self.ids[some] = s[nth], i[nth]


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product that any point of each box can have with each query."""
    return whole.longs(np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T)


def search(tree: Tree, queries: np.ndarray, best: Best, own: np.ndarray | None = None) -> None:
    """Takes the tree's best rows into `best`; own: the queries' own places in the tree, which are no answers."""
    n = len(queries)
    if not n or not len(tree.ids):
        return
    points, asked, *boxes = whole.exact(queries.shape[1], tree.vectors, queries, *tree.low, *tree.high)
    levels = len(tree.bounds)
    low, high = boxes[:levels], boxes[levels:]
    every = np.arange(n)
    nodes = np.array([0])  # those of the level that any query can still use
    for level in range(levels):
        bound = box_bounds(asked, low[level][nodes], high[level][nodes])
        open_ = best.beaten(every[:, None], bound, tree.least[level][nodes][None, :])
        used = open_.any(0)
        nodes, bound, open_ = nodes[used], bound[:, used], open_[:, used]
        if level < levels - 1:
            nodes = np.column_stack([2 * nodes, 2 * nodes + 1]).ravel()
    if not len(nodes):
        return
    bound[~open_] = whole.LEAST
    order = np.argsort(~bound, axis=1, kind="stable")
    done, width = 0, 1
    while done < len(nodes):
        wave = order[:, done : done + width]
        query = np.repeat(every, wave.shape[1])
        place = wave.ravel()
        reach = open_[query, place] & best.beaten(query, bound[query, place], tree.least[-1][nodes[place]])
        query, place = query[reach], place[reach]
        by_leaf = np.argsort(place, kind="stable")
        query, place = query[by_leaf], place[by_leaf]
        found: list[tuple[np.ndarray, ...]] = []
        for a, b in runs(place):
            start, end = tree.bounds[-1][nodes[place[a]]], tree.bounds[-1][nodes[place[a]] + 1]
            q = query[a:b]
            score = whole.longs(asked[q] @ points[start:end].T)
            good = best.beaten(q[:, None], score, tree.ids[start:end][None, :])
            if own is not None:
                good &= own[q][:, None] != np.arange(start, end)[None, :]
            at, row = np.nonzero(good)
            found.append((q[at], score[at, row], tree.ids[start:end][row]))
        if found:
            best.take(*(np.concatenate(x) for x in zip(*found)))
        done, width = done + width, 2 * width


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of each run of equal values."""
    cuts = np.flatnonzero(np.diff(values)) + 1
    yield from zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(values)]]).tolist()) if len(values) else ()


def packed(table: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of four widths, named by the first byte."""
    most = max(int(table.max()), -int(table.min())) if table.size else 0
    kind = next(k for k in ("i1", "i2", "i4", "i8") if most < 1 << (8 * int(k[1]) - 1) or k == "i8")
    return bytes([int(kind[1])]) + table.astype(f"<{kind}").tobytes()


def unpacked(data: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64).reshape(shape)


SHARD = "shard long, n int, ids binary, vectors binary"
SHARD_ARROW = pa.schema([("shard", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])
BLOCK = "home long, n int, places binary, ids binary, vectors binary, scores binary, found binary"
BLOCK_ARROW = pa.schema([("home", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("places", "ids", "vectors", "scores", "found")]])
ANSWER = "home long, place int, query_id long, vec_id long, score long"
ANSWER_ARROW = pa.schema([("home", pa.int64()), ("place", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def one_row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


def sharded(rows: DataFrame, length: int, shard_rows: int, leaf: int) -> DataFrame:
    """rows (vec_id, v of one length) -> one row per shard, in tree order."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        first, made = TaskContext.get().partitionId() << 32, 0

        def shard() -> pa.RecordBatch:
            ids, vectors = (np.concatenate(x) for x in zip(*held))
            order = tree_order(vectors, ids, leaf)
            return one_row(SHARD_ARROW, first + made, len(ids), packed(ids[order]), packed(vectors[order]))

        for batch in batches:
            ids = batch.column(0).fill_null(whole.MOST).to_numpy(zero_copy_only=False)
            vectors = whole.matrix(batch.column(1), length)
            while len(ids):
                room = shard_rows - sum(len(h[0]) for h in held)
                held.append((ids[:room], vectors[:room]))
                ids, vectors = ids[room:], vectors[room:]
                if sum(len(h[0]) for h in held) == shard_rows:
                    yield shard()
                    held, made = [], made + 1
        if held:
            yield shard()

    return rows.mapInArrow(build, SHARD)


def answers(home: np.ndarray, place: np.ndarray, query_ids: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> pa.Table:
    """One row for each answer; free places have none."""
    k = scores.shape[1]
    ids, scores = ids.ravel(), scores.ravel()
    kept = ~((scores == whole.LEAST) & (ids == whole.MOST))
    columns = [np.repeat(home, k), np.repeat(place, k), np.repeat(query_ids, k), ids, scores]
    arrays = [pa.array(c[kept]) for c in columns]
    arrays[3] = pa.array(ids[kept], mask=ids[kept] == whole.MOST)
    return pa.Table.from_arrays([a.cast(f.type) for a, f in zip(arrays, ANSWER_ARROW)], schema=ANSWER_ARROW)


def top_k(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, leaf: int = LEAF_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row whose id is divisible by `every`.

    Components become floor(scale * x). Vectors that are null or hold a null or non-finite component take no part. A
    vector shorter than the longest counts as ending in zeros. A null id is no query; as an answer it comes after all
    others of its score. Rows that are repeated, or share an id, are rows of their own: only the query's own row is
    no answer to it. Scores beyond a long take the nearest long. Further columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole.floored(F.col(vector_col), scale).alias("v")).filter("v is not null")
    n, length, most = whole.extent(rows, "v")
    shards = common.cut(sharded(rows.select("vec_id", whole.padded(F.col("v"), length, most).alias("v")), length, shard_rows, leaf))

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, rows_, ids, data in zip(*(c.to_pylist() for c in batch.columns)):
                ids, data = unpacked(ids, rows_), unpacked(data, rows_, length)
                place = np.flatnonzero((ids % every == 0) & (ids != whole.MOST))
                best = Best.none(len(place), k)
                search(tree_of(data, ids, leaf), data[place], best, place)
                if len(place):
                    yield one_row(BLOCK_ARROW, shard, len(place), packed(place), packed(ids[place]), packed(data[place]), packed(best.scores), packed(best.ids))

    blocks = common.cut(shards.mapInArrow(at_home, BLOCK))

    def first_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for home, q, place, ids, _, scores, found in zip(*(c.to_pylist() for c in batch.columns)):
                yield from answers(np.full(q, home), unpacked(place, q), unpacked(ids, q), unpacked(scores, q, k), unpacked(found, q, k)).to_batches()

    def elsewhere(shard: pa.Table, asking: pa.Table) -> pa.Table:
        out = []
        for _, rows_, ids, data in zip(*(shard.column(c).to_pylist() for c in ("shard", "n", "ids", "vectors"))):
            tree = tree_of(unpacked(data, rows_, length), unpacked(ids, rows_), leaf)
            for home, q, place, own_ids, own, scores, found in zip(*(asking.column(c).to_pylist() for c in BLOCK_ARROW.names)):
                best = Best.none(q, k)
                best.limit, best.limit_id = unpacked(scores, q, k)[:, -1], unpacked(found, q, k)[:, -1]
                search(tree, unpacked(own, q, length), best)
                out.append(answers(np.full(q, home), unpacked(place, q), unpacked(own_ids, q), best.scores, best.ids))
        return pa.concat_tables(out) if out else ANSWER_ARROW.empty_table()

    count = max(shards.count(), 1)
    numbered = shards.select("shard").withColumn("target", F.row_number().over(Window.orderBy("shard")) - 1)  # one row per shard_rows rows
    chunks = -(-count // BLOCKS)
    targets = shards.join(numbered, "shard").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asking = blocks.join(numbered.withColumnRenamed("shard", "home"), "home").withColumnRenamed("target", "number")
    asking = asking.withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).filter("target <> number").withColumn("chunk", F.floor(F.col("number") / BLOCKS).cast("int"))
    met = targets.groupBy("target", "chunk").cogroup(asking.groupBy("target", "chunk")).applyInArrow(elsewhere, ANSWER)
    every_answer = blocks.mapInArrow(first_answers, ANSWER).unionByName(met)
    ranked = Window.partitionBy("home", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    out = every_answer.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


ORACLE = """
with kept as (
select vec_id, row_number() over () as n, list_transform(embedding, lambda x: floor(cast(x as double) * 64)) as v from embeddings
where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (select q.vec_id as query_id, q.n, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score from kept q join kept c on q.n <> c.n where q.vec_id % 20 = 0
), ranked as (select *, cast(row_number() over (partition by n order by score desc, vec_id nulls last) as integer) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20"""
