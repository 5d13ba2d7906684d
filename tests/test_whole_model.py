"""The row view is all of lineitem, and best rows are those of brute force."""

import random

from calspar.operators import lookup
from calspar.plans import domain, registry
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_rows_are_all_of_lineitem(spark):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    found = domain.views(spark, DATA)["v_pdf_rows"].groupBy("id").agg(F.count("*").alias("n"))
    whole = lines.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.count("*").alias("n"))
    assert found.exceptAll(whole).isEmpty() and whole.exceptAll(found).isEmpty()
    report = {r["waste_type"]: r["total"] for r in registry.compare_report(spark, DATA).collect()}
    assert report[None] == lines.count()
    assert registry.fix_villages(spark, DATA).count() == lines.count()


def test_best_rows_against_brute_force(spark):
    random.seed(3)
    pick = lambda *of: random.choice(of)
    wanted = sorted({("S", pick("V", "W"), pick("", "A", "B"), pick("", "1", "2", "All")) for _ in range(40)})
    rows = [(random.randrange(60), "S", pick(None, "S", "T"), pick("V", "W"), None, pick(None, "", "A", "B"), pick(None, "A"), pick(None, "", "ALL", "all", "1", "2", "3"), pick("plastikas", "stiklas"), f"k{random.randrange(5)}") for _ in range(300)]
    best = {}
    for s, v, st, b in wanted:
        for i, s0, s1, v0, v1, st0, st1, hn, kind, k in rows:
            street, hn = next((x for x in (st1, st0) if x is not None), ""), hn or ""
            if ((s1 or s0), (v1 or v0)) == (s, v) and street in (st, ""):
                rank = (0 if street == st else 1, 0 if hn == b else 1 if hn.lower() in ("", "all") else 2, i, k)
                best[s, v, st, b, kind] = min(best.get((s, v, st, b, kind), rank), rank)
    names = "id int, seniunija string, mapped_seniunija string, village string, mapped_village string, street string, mapped_street string, house_numbers string, waste_type string, kaimai_hash string"
    found = lookup.best_rows(spark.createDataFrame(wanted, "seniunija string, village string, street string, bucket string"), spark.createDataFrame(rows, names))
    assert sorted(map(tuple, found.collect())) == sorted((*key, k, a, b) for key, (a, b, _, k) in best.items())
