"""Vector codes by ball k-means: every part of a vector becomes the number of the nearest entry of that part's codebook.

All arithmetic is on whole numbers, so the result depends on the rows alone. After the first assignment each entry has a
ball: the parts that it holds, with the radius of the farthest. An entry at d from the ball's own can take a part at r
from the centre only if d <= 2r: entries beyond twice the radius are no neighbours. A part nearer to the centre than
half of the way to the nearest neighbour lies in the stable core and stays. The rest of the ball is cut into rings by the
distances of the neighbours; a part is compared with the neighbours that its ring can reach, and with no other entry.

A round is one pass that writes rows with their codes beside the task's sums for each entry; the sums are added up in
Spark, and only the entries (parts * entries of them, however many rows there are) reach the driver.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, whole

#: Rows that are compared with entries at once.
ROWS = 4096


def nearest(points: np.ndarray, entries: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest of some entries for each point; equal distances: the smallest number."""
    table = whole.squared_distances(points, entries)
    least = table.min(1)
    return np.where(table == least[:, None], numbers[None, :], np.iinfo(np.int64).max).min(1), least


def all_nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`nearest` over all entries, by slices of rows."""
    found = [nearest(points[a : a + ROWS], entries, np.arange(len(entries))) for a in range(0, len(points), ROWS)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def ball_nearest(points: np.ndarray, entries: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`nearest` over all entries for points of which the entries that hold them so far are known."""
    between = whole.squared_distances(entries, entries)
    own = points - entries[held]
    least = (own * own).sum(1)
    number = held.astype(np.int64)
    order = np.lexsort((least, held))
    starts = np.flatnonzero(np.diff(held[order], prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(order)]):
        ball = order[a:b]  # by distance from the centre
        centre = held[ball[0]]
        radius = least[ball[-1]]
        near = np.argsort(between[centre], kind="stable")
        near = near[: np.searchsorted(between[centre][near], 4 * radius, side="right")]  # the centre is the first, or as near
        reach = np.searchsorted(between[centre][near], 4 * least[ball], side="right")
        at = np.searchsorted(reach, 1, side="right")  # the core can reach the centre alone
        while at < len(ball):
            ring = 1 << int(reach[at] - 1).bit_length()  # rings widen twofold
            end = min(np.searchsorted(reach, ring, side="right"), at + ROWS)
            some = ball[at:end]
            number[some], least[some] = nearest(points[some], entries[near[:ring]], near[:ring])
            at = end
    return number, least


def assigned(vectors: np.ndarray, books: np.ndarray, codes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances) of each row and part. books: part x entry x place."""
    parts, _, width = books.shape
    number, error = np.zeros((len(vectors), parts), dtype=np.int64), []
    for p in range(parts):
        points, entries = whole.exact(width, vectors[:, p * width : (p + 1) * width], books[p])
        number[:, p], least = all_nearest(points, entries) if codes is None else ball_nearest(points, entries, codes[:, p])
        error.append(least)
    total = np.sum([e.astype(object) for e in error], axis=0) if any(e.dtype == object or (e.size and float(e.max()) > 1 << 60) for e in error) else np.sum([e.astype(np.int64) for e in error], axis=0)
    return number, whole.longs(np.asarray(total))


STATE = "vec_id long, label {label}, v array<{kind}>, codes binary, part int, entry int, n long, sums array<long>"


def one_pass(rows: DataFrame, books: np.ndarray, length: int) -> DataFrame:
    """rows (vec_id, label, v, codes) with their codes anew, and rows (part, entry, n, sums) of what each task's entries hold."""
    label, kind = rows.schema["label"].dataType.simpleString(), rows.schema["v"].dataType.elementType.simpleString()
    parts, entries, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = whole.matrix(batch.column(2), length)
            before = batch.column(3)
            old = None if before.null_count else np.frombuffer(b"".join(before.to_pylist()), np.uint16).reshape(len(v), parts).astype(np.int64)
            number, _ = assigned(v, books, old)
            for p in range(parts):
                np.add.at(sums[p], number[:, p], v[:, p * width : (p + 1) * width])
                counts[p] += np.bincount(number[:, p], minlength=entries)
            codes = [row.tobytes() for row in number.astype(np.uint16)]
            none = [pa.nulls(len(v), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(codes, pa.binary()), *none], names=names)
            shape[:] = [c.type for c in batch.columns[:3]]
        if counts.any():
            p, e = np.nonzero(counts)
            none = [pa.nulls(len(p), t) for t in (*shape, pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))], names=names)

    names, shape = ["vec_id", "label", "v", "codes", "part", "entry", "n", "sums"], [None] * 3
    return rows.mapInArrow(work, STATE.format(label=label, kind=kind))


def moved(books: np.ndarray, written: DataFrame) -> np.ndarray:
    """The entries once each is put at the floor of the mean of the parts that it holds; those that hold none stay."""
    held = written.filter("part is not null")
    sums = held.select("part", "entry", F.posexplode("sums").alias("place", "x")).groupBy("part", "entry", "place").agg(F.sum("x").alias("x"))
    counts = held.groupBy("part", "entry").agg(F.sum("n").alias("n"))
    out = books.copy()
    for r in sums.join(counts, ["part", "entry"]).collect():  # parts * entries * width rows
        out[r["part"], r["entry"], r["place"]] = r["x"] // r["n"]
    return out


def vector_codes(vectors: DataFrame, scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(rows (vec_id, label, code, error), codebooks part x entry x place).

    Components become floor(scale * x). Rows whose vector is null or holds a null or non-finite component are dropped. A
    vector shorter than the longest, or than the next multiple of `parts`, counts as ending in zeros. The codebooks start
    from the rows of the smallest ids (equal ids: the smaller vector first; null ids last), all of them if they are fewer
    than `entries`. Repeated rows are rows of their own, further columns are ignored, an empty table gives no rows.
    Errors beyond a long take the nearest long. The rows read a table in the shared folder that stays for them.
    """
    spark = vectors.sparkSession
    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), whole.floored(F.col(vector_col), scale).alias("v")).filter("v is not null")
    n, length, most = whole.extent(read, "v", parts)
    length = max(length, parts)
    rows = read.select("vec_id", "label", whole.padded(F.col("v"), length, most).alias("v"), F.lit(None).cast("binary").alias("codes"))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    books = np.array([r["v"] for r in first] or [[0] * length], dtype=np.int64)
    books = books.reshape(len(books), parts, length // parts).transpose(1, 0, 2).copy()
    folder = f"{common.checkpoint_dir(spark).rstrip('/')}/codes-{uuid.uuid4().hex}"
    for k in range(rounds):
        one_pass(rows, books, length).write.parquet(f"{folder}/{k}")
        written = spark.read.parquet(f"{folder}/{k}")
        books = moved(books, written)
        rows = written.filter("part is null").select("vec_id", "label", "v", "codes")
        if k:
            common.deleted(spark, f"{folder}/{k - 1}")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                old = None if batch.column(3).null_count else np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(batch.num_rows, parts).astype(np.int64)
                number, error = assigned(whole.matrix(batch.column(2), length), books, old)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([row.tobytes().hex() for row in number.astype(np.uint8 if entries <= 256 else ">u2")]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    label = read.schema["label"].dataType.simpleString()
    return rows.mapInArrow(finish, f"vec_id long, label {label}, code string, error long"), books


def code_digest(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): the codes with their errors, those of equal labels summed (null: no long holds the sum)."""
    rows, books = vector_codes(vectors)
    rows = common.cut(rows)
    labels = rows.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    joined = rows.alias("r").join(labels.alias("l"), F.col("r.label").eqNullSafe(F.col("l.label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def round_sql(k: int) -> str:
    """One round of assigning and moving in SQL: near<k> from book<k>, then book<k + 1>."""
    return f"""near{k} as (select vec_id, p, v, arg_min(e, (d, e)) as e, min(d) as d from (
  select x.vec_id, x.p, x.v, b.e, list_inner_product(x.v, x.v) + list_inner_product(b.c, b.c) - 2 * list_inner_product(x.v, b.c) as d from parts x join book{k} b on b.p = x.p) t group by vec_id, p, v
), sums{k} as (select p, e, i, sum(x) as s, count(*) as n from (select p, e, unnest(v) as x, generate_subscripts(v, 1) as i from near{k}) t group by p, e, i
), moved{k} as (select p, e, list(cast(floor((s - ((s % n) + n) % n) / n) as double) order by i) as c from sums{k} group by p, e
), book{k + 1} as (select b.p, b.e, coalesce(m.c, b.c) as c from book{k} b left join moved{k} m on m.p = b.p and m.e = b.e)"""


ORACLE = f"""
with kept as (
select vec_id, label, list_transform(embedding, lambda x: floor(cast(x as double) * 1024)) as v from embeddings
where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as materialized (select vec_id, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] as v from kept, (select unnest([0, 1, 2, 3]) as p) q
), book0 as (select p, row_number() over (partition by p order by vec_id) - 1 as e, v as c from parts where vec_id in (select vec_id from kept order by vec_id limit 256)
), {", ".join(round_sql(k) for k in range(4))}
, last as (select x.vec_id, x.p, arg_min(b.e, (list_inner_product(x.v, x.v) + list_inner_product(b.c, b.c) - 2 * list_inner_product(x.v, b.c), b.e)) as e,
  min(list_inner_product(x.v, x.v) + list_inner_product(b.c, b.c) - 2 * list_inner_product(x.v, b.c)) as d from parts x join book4 b on b.p = x.p group by x.vec_id, x.p
), coded as (select vec_id, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from last group by vec_id
), digest as (select sha256(string_agg(array_to_string(list_transform(c, lambda x: cast(x as bigint)), ','), ',' order by p, e)) as codebooks_sha256 from book4)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded join kept using (vec_id), digest"""
