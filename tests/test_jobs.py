"""Readers, retrieval, ontology, tables, history and streams on hand-made data."""

import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from locusloom.functions import columns as C
from locusloom.operators import evidence as ev
from locusloom.operators import harmonise as hz
from locusloom.operators import history as hi
from locusloom.operators import ontology as on
from locusloom.operators import proofs as pf
from locusloom.operators import retrieval as rt
from locusloom.operators import tables as tb
from locusloom.sources import readers as rd
from locusloom.streaming import updates as st


def _bgzf(data: bytes, block: int) -> bytes:
    out = b""
    for i in range(0, len(data), block):
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(data[i:i + block]) + c.flush()
        head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25)
        out += head + body + struct.pack("<II", zlib.crc32(data[i:i + block]), len(data[i:i + block]))
    return out


@pytest.mark.parametrize("suffix", ["tsv", "tsv.gz", "tsv.bgz"])
def test_read_sumstats_skips_preamble(spark, tmp_path, suffix):
    text = "##source=x\n##y\n#chrom\tpos\trsid\n" + "".join(f"1\t{i}\trs{i}\n" for i in range(200))
    path = tmp_path / f"a.{suffix}"
    data = text.encode()
    path.write_bytes(gzip.compress(data) if suffix == "tsv.gz" else _bgzf(data, 37) if suffix == "tsv.bgz" else data)
    df = rd.read_sumstats(spark, str(path))
    assert df.columns == ["chrom", "pos", "rsid"]
    assert sorted(int(r.pos) for r in df.collect()) == list(range(200))


def test_space_separated_header(spark, tmp_path):
    (tmp_path / "a.txt").write_text("SNP A1\nrs1 A\nrs2 C\n")
    assert {tuple(r) for r in rd.read_sumstats(spark, str(tmp_path / "a.txt")).collect()} == {("rs1", "A"), ("rs2", "C")}


def test_first_alias_wins_whatever_the_case(spark):
    df = spark.createDataFrame([("x", "y", 1.0, 2.0)], "SNP string, MarkerName string, Beta double, LogOR double")
    out = hz.canonical_columns(df).head()
    assert (out.snp, out.beta) == ("y", 2.0)
    assert hz.is_ldsc_format(["Z", "SNP", "N"]) and not hz.is_ldsc_format(["Z", "SNP", "BETA"])


def test_bad_ids_and_stamps(spark):
    df = spark.createDataFrame([("1:5:A:C",), ("1:x:A:C",), ("1:5:A",)], "id string")
    assert [r[0] is not None for r in df.select(C.parsed_variant_id(F.col("id"))).collect()] == [True, False, False]
    t = spark.createDataFrame([("2024-01-02T03:04:05.678+00:00Z",)], "s string").select(F.unix_millis(C.parse_stamp(F.col("s")))).head()[0]
    assert t == 1704164645678


def test_contains_pairs_equals_brute_force(spark):
    texts = [(6, "y" * 80), (7, "y" * 64 + "z" * 9), (0, "aaaa abcabc"), (1, "xABCDx"), (2, ""), (3, "bca\nbcd"), (4, "\U0001F600abc"), (5, None)]
    pats = [("Y" * 70,), ("y" * 64 + "z",), ("abc",), ("bcd",), ("ABCD",), ("aaa",), ("zzz",)]
    t = spark.createDataFrame(texts, "id int, text string")
    p = spark.createDataFrame(pats, "pat string")
    got = {(r.id, r.pat) for r in rt.contains_pairs(t, p, "id", "text", "pat", "pat").collect()}
    assert got == {(i, q) for i, s in texts for (q,) in pats if s and q.lower() in s.lower()}


def test_passages_of_empty_and_exact_texts(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, "a b c d", None), (3, "", "t")], "id int, text string, title string")
    got = {(r.id, r.block): (r.title, r.passage) for r in rt.passages(df, ["id"], "text", "title", words=2).collect()}
    assert got == {(2, 0): ("", "a b"), (2, 1): ("", "c d"), (3, 0): ("t", "")}


def test_closure_of_a_graph_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("a", "c")], "child string, parent string")
    got = {(r.node, r.ancestor): r.depth for r in on.ancestors(edges).collect()}
    assert got[("a", "c")] == 1 and got[("d", "b")] == 3 and got[("b", "a")] == 2 and got[("d", "d")] == 0
    assert len(got) == 3 * 3 + 4


def test_last_descendant_entry_wins(spark):
    d = spark.createDataFrame([("p1", "x", 1), ("p2", "x", 2), ("p2", "p1", 2)], "parent string, descendant string, ord int")
    assert {r.id: r.parent for r in on.descendant_map(d).collect()} == {"x": "p2", "p1": "p2", "p2": "p2"}


def test_impact_classes(spark):
    rows = [(None, None), (0.9, 0.001), (0.6, None), (None, 0.5), (0.1, 0.01)]
    df = spark.createDataFrame(rows, "v double, s double").select(C.impact(F.col("v"), F.col("s")).alias("i")).select("i.*")
    assert [tuple(r) for r in df.collect()] == [(False, "no_data"), (True, "high"), (True, "medium"), (False, "low"), (True, "medium")]


def test_noisy_or_counts_a_rule_once_and_grows_with_rules(spark):
    rows = [("s", 1, "regulatory_effect"), ("s", 1, "regulatory_effect"), ("s", 2, "regulatory_effect"), ("s", 2, "eqtl_association")]
    df = spark.createDataFrame(rows, "snp string, gene_key int, rule string")
    got = {r.gene_key: r.score for r in ev.noisy_or(df).collect()}
    assert got == pytest.approx({1: 0.34, 2: 1 - 0.66 * 0.9824})


def test_sampled_frequency_approaches_its_expectation(spark):
    df = spark.createDataFrame([("s", 1, "regulatory_effect"), ("s", 1, "eqtl_association")], "snp string, gene_key int, rule string")
    got = {r.rule: r.prob for r in pf.sampled_proofs(df, 20_000).collect()}
    want = {r.rule: r.prob for r in pf.expected_first(df).collect()}
    assert got == pytest.approx(want, abs=0.01)


def test_paged_arrays_stay_bounded_and_whole(spark):
    df = spark.range(95).withColumn("k", F.lit(1))
    pages = tb.paged(df, ["k"], F.floor(F.col("id") / 10), [F.col("id")], F.col("id"), "ids", 20).collect()
    assert max(len(r.ids) for r in pages) == 20
    assert [i for r in sorted(pages, key=lambda r: r.page) for i in r.ids] == list(range(95))


def test_progress_weights(spark):
    rows = [("h", t, "completed") for t in [*hi.ENRICHMENT_WEIGHTS, *hi.HYPOTHESIS_WEIGHTS]] + [("g", "Predicting causal gene", "completed"), ("g", "Getting gene data", "failed")]
    df = spark.createDataFrame(rows, "hypothesis_id string, task string, state string")
    assert {r.hypothesis_id: r.progress for r in hi.progress(df).collect()} == {"h": 100.0, "g": 20.0}


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (1, 2, 0)])
@pytest.mark.parametrize("files", [1, 9])
def test_runs_do_not_depend_on_batches(spark, tmp_path, order, files):
    """The same three updates, in any order, one file per trigger or all at once, make the same run."""
    schema = "hypothesis_id string, event_id bigint, ts timestamp, task string, state string, progress double, details string"
    rows = [("h", 1, "Getting candidate genes", "completed"), ("h", 2, "Predicting causal gene", "completed"), ("h", 3, "Creating enrich data", "completed")]
    for k in order:
        h, e, t, s = rows[k]
        part = spark.createDataFrame([(h, e, None, t, s, 0.0, None)], schema).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000 + e)))
        part.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    own = st.streaming_session(spark)
    live = own.readStream.schema(schema).option("maxFilesPerTrigger", files).json(str(tmp_path / "in"))
    closed, end = st.with_end(live, spark)
    out = st.run_to_parquet(st.finished_runs(closed), spark, "t", end=end).collect()
    assert [(r.hypothesis_id, r.updates, r.progress, r.state) for r in out] == [("h", 3, 50.0, "completed")]


def test_replayed_updates_pass_once(spark, tmp_path):
    schema = "hypothesis_id string, event_id bigint, ts timestamp, task string"
    df = spark.createDataFrame([("h", 1, None, "a"), ("h", 2, None, "a"), ("h", 3, None, "b")], schema).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    for _ in range(2):
        df.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    live = st.streaming_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    assert sorted(r.task for r in st.run_to_parquet(st.distinct_updates(live), spark, "d").collect()) == ["a", "b"]
