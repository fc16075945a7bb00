from locusloom.sources import readers as rd


def test_lines_of_many_small_files_are_read_once(spark, tmp_path):
    want = set()
    for k in range(5):
        folder = tmp_path / f"region={k}"
        folder.mkdir()
        (folder / "part-0.txt").write_text("".join(f"{k}-{i}\n" for i in range(k + 1)))
        want |= {(k, i, f"{k}-{i}") for i in range(k + 1)}
    got = rd.with_line_number(spark.read.text(str(tmp_path)), "line", ["region"])
    assert {(r.region, r.line, r.value) for r in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert "FileScan text" not in plan  # the files themselves are not opened again by the numbering
