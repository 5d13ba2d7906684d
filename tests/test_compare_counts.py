"""Rows alike are compared once and counted, and a large table of rows isn't shuffled to be matched."""

from calspar.operators import compare


def test_rows_that_stand_for_several(spark):
    each = spark.createDataFrame([("a", "overlap", 3), ("a", "empty", 2), ("b", "no_match", 4), ("b", "conflict", 1)], "waste_type string, outcome string, times long")
    spread = each.selectExpr("waste_type", "outcome", "explode(sequence(1L, times)) as k")
    got, want = compare.report(each, each["times"]), compare.report(spread)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert (None, 10, 4, 3, 3, 4) in [tuple(r) for r in got.collect()]


def test_matching_leaves_rows_where_they_are(spark):
    names = "seniunija string, mapped_seniunija string, village string, mapped_village string, street string, mapped_street string, house_numbers string"
    rows = spark.createDataFrame([(k, "S", None, "V k.", None, "A g." if k % 2 else None, None, None) for k in range(8)], f"id long, {names}")
    locations = spark.createDataFrame([(1, "S", "V", "A", None, "k1")], "id long, seniunija string, village string, street string, house_numbers string, kaimai_hash string")
    matched = compare.match(rows, locations)
    plan = matched._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((r.id, r.match_method) for r in matched.collect()) == [(k, "exact" if k % 2 else "village_only") for k in range(8)]
