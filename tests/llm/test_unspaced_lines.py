"""Line dedup of lines without spaces, and of those parted by other white space."""

from pyspark.sql import functions as F

from calspar.llm import lines

CHINESE = "今天天气很好我们一起去公园散步吧然后回家吃饭看书睡觉"
URL = "https://example.org/a/very/long/path/of/one/token/that/has/no/space?key=0123456789abcdef"
TABBED = "alpha\tbeta\tgamma\tdelta"
ROW = "one\ttwo\tthree\tfour\tfive\tsix\tseven\teight"


def test_lines_without_spaces(spark):
    kept = [
        CHINESE, URL, TABBED, ROW, "版权所有", "alpha beta", "short/token", "abcdefgh" * 6, " ".join("abcdefgh" * 6),
        "那天天气不好我们一起去公园散步吧然后回家吃饭看书睡觉", "ครั้งหนึ่งนานมาแล้วมีเด็กชายคนหนึ่ง", "first, second",
    ]
    again = [
        (CHINESE, False), (CHINESE.replace("公", "花"), False), (CHINESE[:9] + CHINESE[10:], False), (CHINESE[:4] + "真" + CHINESE[4:], False), (CHINESE.replace("公园", "海边"), True),
        (URL, False), (URL.upper() + "\r", False), (URL.replace("key=0", "key=1"), False), (URL + "12", True), (TABBED, False), (TABBED.replace("\t", " "), False), (TABBED.replace("beta", "b"), True),
        (ROW.replace("five", "5"), False), (ROW.replace("\t", "　"), False), (ROW.replace("one\ttwo", "1\t2"), True), ("版权所有", False), ("alpha beta", False), ("short/token", False), ("short/tokens", True), (kept[10], False),
    ]
    docs = [(0, "\n".join(kept))] + [(k + 1, l) for k, (l, _) in enumerate(again)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in lines.line_digest(table).collect()}
    assert got == {0: (len(kept), 0)} | {k + 1: (1, 0 if stays else 1) for k, (_, stays) in enumerate(again)}


def test_rare_spaces_are_the_spaces(spark):
    text = "".join(chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x10000)))
    row = spark.createDataFrame([(text,)], "text string").select(F.regexp_replace("text", lines.SPACES, " ").alias("a"), F.regexp_replace("text", lines.RARE_SPACES, " ").alias("b")).first()
    assert row.a == row.b != text
