"""Many small workbooks are read by few tasks, each once, with their headings."""

from calspar.sources import xlsx


def test_small_workbooks_share_a_task(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"w{k:02}.xlsx").write_bytes(xlsx.workbook([["title"], [" b ", "a"][:: 1 if k % 2 else -1], [f"x{k}", f"y{k}"], [None, f"z{k}"]]))
    (tmp_path / "short.xlsx").write_bytes(xlsx.workbook([["title"]]))
    (tmp_path / "torn.xlsx").write_bytes(b"PK")
    reader = xlsx.XlsxReader({"path": str(tmp_path)})
    groups = reader.partitions()
    assert len(groups) == 1 and len(groups[0].names) == 42
    xlsx.register(spark)
    read = xlsx.with_headings(spark.read.format("xlsx").option("path", str(tmp_path)).load(), ["a", "b", "none"])
    assert read._jdf.queryExecution().sparkPlan().toString().count("BatchScan") == 1
    got = sorted(tuple(r) for r in read.collect())
    want = []
    for k in range(40):
        for row, (first, second) in ((3, (f"x{k}", f"y{k}")), (4, (None, f"z{k}"))):
            want.append((f"w{k:02}.xlsx", row, second if k % 2 else first, first if k % 2 else second, None))
    assert got == sorted(want, key=lambda r: r[:2])


def test_a_group_ends_at_its_bytes(tmp_path, monkeypatch):
    for k in range(5):
        (tmp_path / f"w{k}.xlsx").write_bytes(b"x" * 100)
    monkeypatch.setattr(xlsx, "GROUP_BYTES", 250)
    assert [p.names for p in xlsx.XlsxReader({"path": str(tmp_path)}).partitions()] == [["w0.xlsx", "w1.xlsx"], ["w2.xlsx", "w3.xlsx"], ["w4.xlsx"]]
