"""Readers for the text formats of association studies and knowledge dumps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import partial, reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusloom.functions.running import numbered
from locusloom.functions.session import saved
from locusloom.sources import blockgzip

BIM_SCHEMA = "chr int, snp string, cm double, pos bigint, a1 string, a2 string"
ANNOTATED_SCHEMA = (
    "chrom string, pos bigint, ref string, alt string, coding string, hugo string, so string, "
    "vest_score double, vest_pval double, sift_score double, sift_prediction string"
)


def first_line(spark: SparkSession, path: str) -> str:
    """First line that is no ``##`` preamble, taken from the start of one file."""
    lines = spark.read.text(path).filter(F.col("_metadata.file_block_start") == 0)
    row = lines.filter(~F.col("value").startswith("##")).select("value").head()
    if row is None:
        raise ValueError(f"no header line in {path}")
    return row[0]


def sniff_separator(header: str) -> str:
    return "\t" if "\t" in header else ("," if "," in header and " " not in header else " ")


def clean_header(names: list[str]) -> list[str]:
    return [n.strip('"').lstrip("#").strip() for n in names]


def _headers(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """Files by their first line that is no ``##`` preamble."""
    lines = spark.read.text(files).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    first = lines.filter((F.col("file_block_start") == 0) & ~F.col("value").startswith("##"))
    found: dict[str, list[str]] = {}
    for row in first.groupBy("file_path").agg(F.min_by("value", "at").alias("header")).orderBy("file_path").collect():
        found.setdefault(row.header, []).append(unquote(row.file_path))
    return found


def read_sumstats(spark: SparkSession, path: str, range_bytes: int = blockgzip.RANGE_BYTES) -> DataFrame:
    """Delimited summary statistics, every column as text.

    Files are read by their own headers and united by column name; a file's missing columns are null. Preamble and
    header lines are filtered by value, so plain files stay splittable, and so do ``.bgz`` files, by ranges of ``range_bytes`` compressed bytes.
    """
    files = [unquote(f) for f in spark.read.text(path).inputFiles()]
    blocked = [f for f in files if f.endswith(".bgz")]
    plain = [f for f in files if not f.endswith(".bgz")]
    groups = _headers(spark, plain) if len(plain) > 1 else {first_line(spark, plain[0]): plain} if plain else {}
    parts, by_header = [], {}
    for f, header in blockgzip.header_lines(blocked).items():
        by_header.setdefault(header, []).append(f)
    for header, members in by_header.items():
        if header:
            parts.append(_split_lines(blockgzip.read_lines(spark, members, range_bytes), header))
        elif header is None:
            parts += [_split_lines(lines, lines.filter(~F.col("value").startswith("##")).head()[0]) for lines in map(partial(read_gzip_lines, spark), members)]
    for header, members in groups.items():
        sep = sniff_separator(header)
        names = clean_header(header.split(sep))
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        rows = spark.read.schema(schema).option("sep", sep).csv(members)
        head = F.col(f"`{names[0]}`")
        raw_head = header.split(sep)[0].strip('"')
        parts.append(rows.filter(head.isNull() | ~(head.startswith("##") | (head == raw_head))))
    if not parts:
        raise ValueError(f"no file in {path}")
    if not set.intersection(*[set(p.columns) for p in parts]):
        raise ValueError(f"the files of {path} have no column in common")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_gzip_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a ``.bgz`` file of other gzip members, or in a store that Arrow can't open: one value, read by one task."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rest, tail = memoryview(content), b""
                while len(rest):
                    block = zlib.decompressobj(31)
                    tail += block.decompress(rest)
                    rest = memoryview(block.unused_data)
                    *full, tail = tail.split(b"\n")
                    if full:
                        yield pd.DataFrame({"value": [x.decode() for x in full]})
                if tail:
                    yield pd.DataFrame({"value": [tail.decode()]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "value string")


def _split_lines(lines: DataFrame, header: str) -> DataFrame:
    kept = lines.filter(~F.col("value").startswith("##"))
    sep = sniff_separator(header)
    names = clean_header(header.split(sep))
    cells = F.split("value", "\\" + sep if sep == "," else sep)
    return kept.filter(F.col("value") != header).select(*[cells[i].alias(n) for i, n in enumerate(names)])


def read_bim(spark: SparkSession, path_glob: str) -> DataFrame:
    """Variant map files of all chromosomes in one scan."""
    return spark.read.schema(BIM_SCHEMA).option("sep", "\t").csv(path_glob)


def with_line_number(scan: DataFrame, name: str = "line", keys: Sequence[str] = ()) -> DataFrame:
    """Number the rows of a file scan from 0, in order of file name and place in the file.

    ``keys`` (folder partitions) restart the count. Rows of one file block reach one task
    in file order; blocks are numbered by their counts, so no task sees more than one block. The scan is read twice, so it is
    computed once and saved: opening many small files costs more than their lines.
    """
    placed = scan.select(
        "*", F.struct("_metadata.file_path", "_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__seq"),
    )
    ranked = numbered(saved(placed, "lines"), keys, F.col("__block"), [F.col("__seq")], "__k")
    return ranked.withColumn(name, (F.col("__k") - 1).cast("long")).drop("__block", "__seq", "__k")


def read_ld_matrix(spark: SparkSession, matrix_path: str, labels_path: str) -> DataFrame:
    """Square tab-separated matrices + one label per line -> (region, i, j, r).

    Both folders hold one ``region=...`` folder per matrix; missing values become 0.
    """
    labels = with_line_number(spark.read.text(labels_path), "line", ["region"]).withColumn("label", F.trim("value"))
    rows = with_line_number(spark.read.text(matrix_path), "line", ["region"])
    cells = rows.select("region", "line", F.posexplode(F.split("value", "\t")).alias("col", "cell"))
    r = F.coalesce(F.nanvl(F.col("cell").try_cast("double"), F.lit(0.0)), F.lit(0.0))
    long = cells.select("region", "line", F.col("col").cast("long").alias("col"), r.alias("r"))
    return (
        long.join(labels.select("region", "line", F.col("label").alias("i")), ["region", "line"])
        .join(labels.select("region", F.col("line").alias("col"), F.col("label").alias("j")), ["region", "col"])
        .select("region", "i", "j", "r")
    )


def read_signal_tables(spark: SparkSession, path_glob: str, columns: list[str]) -> DataFrame:
    """Whitespace-separated result tables, one file per chromosome, tagged with CHR."""
    cells = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path_glob).filter(F.trim("value") != "")
    chr_ = F.regexp_extract(F.col("_metadata.file_path"), r"chr(\d+)", 1).cast("int")
    rows = lines.select(*[cells[i].alias(c) for i, c in enumerate(columns)], chr_.alias("CHR"))
    return rows.filter(F.col(columns[0]) != columns[0])


def read_track_json(spark: SparkSession, path: str, track: str, tf: str) -> DataFrame:
    """Interval-track responses -> the sites of one factor (name compared in lower case)."""
    item = "array<struct<chrom:string,chromStart:bigint,chromEnd:bigint,name:string>>"
    responses = spark.read.text(path).select(F.from_json("value", f"struct<`{track}`:{item}>").alias("doc"))
    sites = responses.select(F.explode(F.col(f"doc.`{track}`")).alias("s")).select("s.*")
    return sites.filter(F.lower("name") == tf.lower()).select(
        F.format_string("%s_%d_%d_grch38", "chrom", "chromStart", "chromEnd").alias("id"),
        F.col("chrom").alias("chr"), F.col("chromStart").alias("start"), F.col("chromEnd").alias("end"),
        F.lower("name").alias("tf"),
    )


def read_annotated_variants(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANNOTATED_SCHEMA).option("sep", "\t").csv(path)


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("title string, text string").option("sep", "\t").csv(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nested documents, one JSON object per line, with a declared schema."""
    return spark.read.schema(schema).json(path)


def read_descendants(spark: SparkSession, path: str) -> DataFrame:
    """``{parent: [descendants]}`` maps -> (parent, descendant) rows."""
    maps = spark.read.text(path).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return maps.select(F.explode("m").alias("parent", "kids")).select("parent", F.explode("kids").alias("descendant"))


def side_by_side(data: DataFrame, labels: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Join two files row by row on their line number and rename label columns."""
    right = with_line_number(labels, "__line").withColumnsRenamed(renames)
    return with_line_number(data, "__line").join(right, "__line").drop("__line")


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """``[Term]`` stanzas -> (id, name, desc), by tag and not by line offset."""
    stanzas = spark.read.option("lineSep", "\n\n").text(path)
    tag = lambda t: F.regexp_extract("value", rf"(?m)^{t}: (.*)$", 1)
    desc = F.regexp_extract("value", r'(?m)^def: "((?:[^"\\]|\\.)*)"', 1)
    return stanzas.filter(F.col("value").contains("[Term]")).select(
        tag("id").alias("id"), tag("name").alias("name"), F.nullif(desc, F.lit("")).alias("desc")
    )
