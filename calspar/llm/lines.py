"""Line dedup by a deletion-neighbourhood join, in DataFrame functions alone.

Lines are compared as sequences of words, trimmed and in lower case; any white space parts words. Of equal lines only
the earliest occurrence stays, however short they are; blank lines always stay. The edit bound is one word edit (a
word replaced, inserted or deleted) for lines of `near_words` words or more, and none for shorter ones, so a line
differs in no more than one part in near_words from the one it repeats. A long line of few
words (text without spaces, a URL) is compared as a sequence of characters, with the bound of one character: see `with_words`.
A line also goes if it is within the bound of a line
that first occurs earlier, whether that one stays or not. Two lines are within one edit exactly if deleting one word
of the one gives the other, or deleting the word at the same place of each gives the same: so every line emits the
hashes of all its deletions, equal hashes are joined, and the earliest line of each joined group is verified.

Hot lines never meet in one task: equal lines are aggregated before anything is joined, groups of equal deletions are
reduced to their earliest line by a partial aggregate, and no pairs are made within a group. Deletions are emitted only
for lines that share their first or second half with another line; lines within one edit always do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The default of near_words: one edit is allowed for lines of so many words or more.
NEAR_WORDS = 8
#: Shorter lines are compared by characters from so many bytes on, and so many a word: 16 characters of Chinese.
NEAR_BYTES, WORD_BYTES = 48, 16
#: White space other than the space and the line feed.
SPACES = r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: What a line has if it isn't blank; found at its first character as a rule.
VISIBLE = SPACES.replace("[", "[^ ")
#: SPACES, but characters of two ranges without any of them, nearly all of a text, are passed by before the longer class is tried.
RARE_SPACES = r"(?![ -~\u00a1-\u167f])" + SPACES


def keyed(docs: DataFrame) -> DataFrame:
    """docs' rows in a struct with (doc_id, text, k): k tells apart texts of one id."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("doc_id", "text").alias("k"))


def with_words(docs: DataFrame, near_words: int) -> DataFrame:
    """(doc_id, k, line, words, near, h1, h2): one row per line that isn't blank.

    words are a line's words or, with a line feed after each, its characters; near: whether it is compared with others than its equals.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("k"), F.posexplode(F.split("text", "\n")).alias("line", "raw")).filter(F.col("raw").rlike(VISIBLE))
    rows = rows.select("doc_id", "k", "line", F.trim(F.regexp_replace(F.lower("raw"), RARE_SPACES, " ")).alias("norm"))
    rows = rows.select("*", F.split("norm", " ").alias("words"), F.octet_length("norm").alias("size"))
    many = F.size("words") >= near_words
    letters = ~many & (F.col("size") >= NEAR_BYTES) & (F.col("size") >= F.size("words") * WORD_BYTES)
    words = F.when(letters, F.transform(F.split("norm", ""), lambda c: F.concat(c, F.lit("\n")))).otherwise(F.col("words"))
    keys = [F.xxhash64("norm").alias("h1"), F.xxhash64("norm", F.lit(1)).alias("h2")]
    return rows.select("doc_id", "k", "line", words.alias("words"), (many | letters).alias("near"), *keys)


def line_table(docs: DataFrame, near_words: int) -> DataFrame:
    """(doc_id, k, line, h1, h2, halves): one narrow row per line; halves is null for lines that go only as equal copies."""
    return with_words(docs, near_words).select("doc_id", "k", "line", "h1", "h2", F.when(F.col("near"), halves()).alias("halves"))


def halves() -> Column:
    """Keys of which two lines within one edit share one: the halves of a line as it is, and as if it had one word less."""

    def pair(n: Column) -> list[Column]:
        head = F.floor(n / 2).cast("int")
        tail = n - head
        return [
            F.xxhash64(F.lit("head"), n, F.slice("words", F.lit(1), head)),
            F.xxhash64(F.lit("tail"), n, F.slice("words", F.size("words") - tail + 1, tail)),
        ]

    return F.array(*pair(F.size("words")), *pair(F.size("words") - 1))


def near_lines(docs: DataFrame, lines: DataFrame, near_words: int) -> DataFrame:
    """(h1, h2) of the lines within one edit of a line that first occurs earlier."""
    half = lines.select("h1", "h2", F.explode("halves").alias("half"))
    shared = common.cut(half.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("half"))
    candidates = common.cut(half.join(common.sized(shared, 24), "half", "left_semi").select("h1", "h2").distinct())
    own = with_words(docs, near_words).join(common.sized(candidates, 32), ["h1", "h2"], "left_semi")
    own = common.cut(own.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "k", "line")).alias("first"), F.first("words").alias("words")))

    # a sequence's hash is the sum of its words' hashes with their places: a deletion moves the later words down by one
    words = own.repartition("h1", "h2").select("h1", "h2", F.size("words").alias("n"), F.posexplode("words").alias("p", "word"))
    words = words.select("h1", "h2", "n", "p", F.xxhash64("word", F.col("p")).alias("here"), F.xxhash64("word", F.col("p") - 1).alias("moved"))
    whole = Window.partitionBy("h1", "h2")
    ahead = whole.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)

    def total(column: str, window) -> Column:  # sums of 64-bit hashes may wrap: as decimals they don't overflow
        return F.coalesce(F.sum(F.col(column).cast("decimal(20,0)")).over(window), F.lit(0).cast("decimal(30,0)"))

    # less than 2^33 words a line: each sum fits
    less = total("here", ahead) + total("moved", whole) - total("moved", ahead) - F.col("moved")
    rows = words.select("h1", "h2", "n", "p", less.cast("decimal(38,0)").alias("less"), F.when(F.col("p") == 0, total("here", whole)).cast("decimal(38,0)").alias("all"))
    deleted = common.cut(rows.select("h1", "h2", F.col("p").alias("place"), F.xxhash64("less", F.col("n") - 1).alias("v"), F.when(F.col("p") == 0, F.xxhash64("all", "n")).alias("entire")))
    entire = deleted.filter("entire is not null").select("h1", "h2", F.col("entire").alias("v"))

    first = own.select("h1", "h2", "first")
    alike = deleted.groupBy("v", "place").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("v", "place")
    alike = deleted.join(common.sized(common.cut(alike), 32), ["v", "place"], "left_semi").select("h1", "h2", "v", "place")
    alike = common.cut(alike.join(common.sized(first, 64), ["h1", "h2"]))  # few: lines with a partner
    earliest = alike.groupBy("v", "place").agg(F.min(F.struct("first", "h1", "h2")).alias("e"))
    replaced = alike.join(earliest, ["v", "place"]).filter("e.first < first").select("h1", "h2", F.col("e.h1").alias("e1"), F.col("e.h2").alias("e2"))

    # each deletion meets at most the one line that it equals
    inside = deleted.select("v", F.col("h1").alias("l1"), F.col("h2").alias("l2")).join(common.sized(entire, 32), "v").select("l1", "l2", "h1", "h2").distinct()
    inside = inside.join(common.sized(first, 64), ["h1", "h2"]).join(common.sized(first.toDF("l1", "l2", "long_first"), 64), ["l1", "l2"])
    inside = common.cut(inside)
    shorter = inside.filter("first < long_first").select(F.col("l1").alias("h1"), F.col("l2").alias("h2"), F.col("h1").alias("e1"), F.col("h2").alias("e2"))
    longer = inside.filter("long_first < first").groupBy("h1", "h2").agg(F.min(F.struct("long_first", "l1", "l2")).alias("e")).select("h1", "h2", "e.l1", "e.l2").toDF("h1", "h2", "e1", "e2")
    links = common.cut(replaced.unionByName(longer).unionByName(shorter).distinct())
    texts = own.select("h1", "h2", "words")
    pairs = links.join(texts, ["h1", "h2"]).join(texts.toDF("e1", "e2", "other"), ["e1", "e2"])
    return pairs.filter(within_one_edit()).select("h1", "h2").distinct()


def within_one_edit() -> Column:
    """Over array columns `words` and `other`: what is left between the longest common head and tail is at most one word on each side."""
    a, b = F.size("words"), F.size("other")
    short = F.least(a, b)

    def alike(turn: bool) -> Column:
        x, y = (F.reverse("words"), F.reverse("other")) if turn else (F.col("words"), F.col("other"))
        differ = F.array_position(F.zip_with(F.slice(x, 1, short), F.slice(y, 1, short), lambda p, q: p != q), True)
        return F.when(differ == 0, short).otherwise(differ - 1)

    return (F.abs(a - b) <= 1) & (alike(False) + alike(True) >= F.greatest(a, b) - 1)


def lost_lines(docs: DataFrame, near_words: int) -> DataFrame:
    """(doc_id, k, lost): for documents that lose lines, the places of those, from 0. Lines that nothing repeats are never moved."""
    lines = common.cut(line_table(docs, near_words))
    first = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "k", "line")).alias("first"), F.count("*").alias("n"))
    near = common.sized(common.cut(near_lines(docs, lines, near_words)), 64)
    marked = common.cut(first.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").filter("n > 1 or near").select("h1", "h2", "first", "near"))
    found = lines.select("doc_id", "k", "line", "h1", "h2").join(common.sized(marked, 80), ["h1", "h2"])
    lost = found.filter(F.col("near").isNotNull() | ~F.struct("doc_id", "k", "line").eqNullSafe(F.col("first")))
    return lost.groupBy("doc_id", "k").agg(F.collect_set("line").alias("lost"))


def dedup_rows(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """(row, doc_id, text, n_lines, n_removed): each input row in a struct, and its text without the lines that go.

    Lines end at line feeds; blank lines always stay. A null text has no lines and stays
    null; rows with equal id and text count as one document and keep the same lines; null ids come first.
    """
    rows, lost = keyed(docs), lost_lines(docs, near_words)
    on = rows.doc_id.eqNullSafe(lost.doc_id) & (rows.k == lost.k)
    joined = rows.join(lost, on, "left").select(rows.row, rows.doc_id, rows.text, lost.lost)
    # generated, so that the text is split once and not for each line that is taken from it
    split = joined.select("*", F.explode(F.array(F.when(F.col("lost").isNotNull(), F.split("text", "\n")))).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    kept = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return split.select(
        "row",
        "doc_id",
        F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_removed"),
        F.explode(F.array(kept)).alias("text"),  # generated, too: a filter on the text doesn't join its lines again
    )


def line_digest(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, kept_sha256 (of the text that is left; a null text counts as empty)."""
    return dedup_rows(docs, near_words).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def dedup_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """docs with their texts less the lines that go; documents that lose every line with a word go too. Columns unchanged, but n_chars, if there is one, follows the text."""
    rows = dedup_rows(docs, near_words).filter((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[changed[c].alias(c) if c in changed and c in docs.columns else F.col("row").getField(c).alias(c) for c in docs.columns])


ORACLE = r"""
with line as (
  select doc_id, i, l, trim(lower(l)) as s, len(string_split(trim(lower(l)), ' ')) as n
  from (select doc_id, string_split(text, chr(10)) as ls from documents), unnest(ls) with ordinality as t(l, i)
), first as (
  select s, n, string_split(s, ' ') as w, min({'d': doc_id, 'i': i}) as f from line where s <> '' group by s, n
), gone as (
  select s, w, n, f, p, array_to_string(list_concat(w[1 : p - 1], w[p + 1 :]), ' ') as v from first, unnest(range(1, n + 1)) as t(p) where n >= 8
), near as (
  select a.s from gone a join gone b on a.v = b.v and a.p = b.p and a.n = b.n and b.f < a.f
  union select a.s from gone a join first b on a.v = b.s and b.n >= 8 and b.f < a.f
  union select b.s from gone a join first b on a.v = b.s and b.n >= 8 and a.f < b.f
), mark as (
  select doc_id, line.i, l, f is null or (f.d = doc_id and f.i = line.i and line.s not in (select s from near)) as keep
  from line left join first on line.s = first.s
)
select d.doc_id, count(m.i) as n_lines, count(m.i) filter (not keep) as n_removed,
  sha256(coalesce(string_agg(l, chr(10) order by m.i) filter (keep), '')) as kept_sha256
from documents d left join mark m on d.doc_id = m.doc_id group by d.doc_id
"""
