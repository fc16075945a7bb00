import gzip
import io
import random

import pyarrow as pa
import pytest

from locusloom.sources import blockgzip as bg
from locusloom.sources import readers as rd


def packed(data: bytes, size: int) -> bytes:
    return b"".join(bg.block(data[i : i + size]) for i in range(0, len(data), size)) + bg.LAST


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
@pytest.mark.parametrize("step", [1, 33, 100, 999, 10**9])
def test_ranges_give_every_line_once(size, step):
    rng = random.Random(size * 31 + step)
    for text in ("", "a", "a\n", "\n\n", "x" * 500, "".join("y" * rng.choice([0, 1, 3, 40]) + "\n" for _ in range(60)), "ab\ncd"):
        file = packed(text.encode(), size)
        if len(file) // step > 3000:
            continue
        got = []
        for at in range(0, len(file), step):
            got += bg.range_lines(pa.PythonFile(io.BytesIO(file), "r"), at, min(at + step, len(file)))
        want = text.split("\n")
        assert [x.decode() for x in got] == (want[:-1] if want[-1] == "" else want)


def test_content_that_looks_like_a_block():
    # stored blocks keep their bytes as they are, so block starts occur inside of content
    rng = random.Random(5)
    data = b"".join(bg.LAST + rng.randbytes(30).replace(b"\n", b".") + b"\n" for _ in range(300))
    file = packed(data, 900)
    got = [x for at in range(0, len(file), 501) for x in bg.range_lines(pa.PythonFile(io.BytesIO(file), "r"), at, at + 501)]
    assert b"\n".join(got) + b"\n" == data


def test_several_tasks_read_one_file(spark, tmp_path):
    rows = "".join(f"1\t{i}\trs{i * 7919 % 100003}\n" for i in range(30_000))
    (tmp_path / "a.bgz").write_bytes(packed(("##x\n#chrom\tpos\trsid\n" + rows).encode(), 5000))
    lines = bg.read_lines(spark, [str(tmp_path / "a.bgz")], range_bytes=20_000)
    assert lines.rdd.getNumPartitions() > 4
    df = rd.read_sumstats(spark, str(tmp_path / "a.bgz"), range_bytes=20_000)
    assert df.columns == ["chrom", "pos", "rsid"]
    assert sorted(int(r.pos) for r in df.collect()) == list(range(30_000))


def test_sink_and_odd_files(spark, tmp_path):
    lines = [f"{i} " + "v" * (i % 900) for i in range(5000)] + ["", None]
    df = spark.createDataFrame([(x,) for x in lines], "value string").repartition(3)
    bg.write_lines(df, f"{tmp_path}/out dir", "head")
    files = sorted((tmp_path / "out dir").iterdir())
    assert len(files) == 3 and all(f.name.startswith("part-") for f in files)
    back = [r.value for r in bg.read_lines(spark, [f"file://{f}" for f in files], 9000).collect()]
    assert sorted(back) == sorted(["head"] * 3 + [x or "" for x in lines])
    (tmp_path / "cut.bgz").write_bytes(packed(b"a\nb\n" * 9000, 700)[:-40])
    with pytest.raises(Exception, match="no whole block"):
        bg.read_lines(spark, [str(tmp_path / "cut.bgz")]).collect()
    assert bg.header_line("viewfs://x/y.bgz") is None and bg.header_line(str(tmp_path / "none.bgz")) is None
    (tmp_path / "plain.bgz").write_bytes(gzip.compress(b"##p\na\tb\n1\t2\n"))
    (tmp_path / "blocks.bgz").write_bytes(packed(b"a\tc\n3\t4\n", 3))
    both = rd.read_sumstats(spark, f"{tmp_path}/[pb]l*.bgz")
    assert sorted((r.a, r.b, r.c) for r in both.collect()) == [("1", "2", None), ("3", None, "4")]
