"""Queries that write the tables out in a reference file format and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusloom.functions import columns as C
from locusloom.functions.running import spread
from locusloom.functions.session import scratch_path
from locusloom.operators import harmonise as hz
from locusloom.plans.fixtures import with_views
from locusloom.plans.registry import query
from locusloom.sources import knowledge as kb
from locusloom.sources import readers as rd
from locusloom.sources import writers as wr
from locusloom.sources.blockgzip import write_lines


@query("sumstats_roundtrip", with_views("variants", """
select chr, bp as pos, snp, a1, a2, round(beta,6) as beta, round(se,6) as se, n from variants"""))
def _(fx):
    path = scratch_path(fx.spark, "sumstats")
    v = fx.variants.select(
        F.col("chr").alias("#CHROM"), F.col("bp").alias("POS"), F.col("snp").alias("ID"), "a1", "a2", "beta", "se",
        F.round(F.col("mlog10p") / 20, 6).alias("P"), F.col("n").alias("N"),
    )
    wr.write_table(v, path)
    back = hz.coerce(hz.canonical_columns(rd.read_sumstats(fx.spark, path)))
    return back.select("chr", "pos", "snp", "a1", "a2", F.round("beta", 6).alias("beta"), F.round("se", 6).alias("se"), "n")


@query("sumstats_block_gzip", with_views("variants", """
select chr, bp as pos, snp, a1, a2, round(beta,6) as beta, n from variants"""))
def _(fx):
    path = scratch_path(fx.spark, "blockgzip")
    names = ["#CHROM", "POS", "ID", "a1", "a2", "beta", "N"]
    cells = [F.col(c).cast("string") for c in ("chr", "bp", "snp", "a1", "a2", "beta", "n")]
    write_lines(fx.variants.select(F.concat_ws("\t", *cells).alias("value")), path, "\t".join(names))
    # short ranges, so that several tasks share a file at every size
    back = hz.coerce(hz.canonical_columns(rd.read_sumstats(fx.spark, path, range_bytes=50_000)))
    return back.select("chr", "pos", "snp", "a1", "a2", F.round("beta", 6).alias("beta"), "n")


@query("bim_union", with_views("variants", """
select chr, snp, bp/1000000.0::double as cm, bp as pos, a1, a2 from variants"""))
def _(fx):
    path = scratch_path(fx.spark, "bim")
    v = fx.variants.select("chr", F.col("chr").alias("c"), "snp", (F.col("bp") / 1e6).alias("cm"), "bp", "a1", "a2")
    v.write.partitionBy("chr").option("sep", "\t").csv(path)
    return rd.read_bim(fx.spark, f"{path}/*/*.csv")


@query("signal_tables", with_views("variants", """
select snp as "SNP", bp, round(beta,6) as beta, chr as "CHR" from variants where p<5e-8"""))
def _(fx):
    path = scratch_path(fx.spark, "signals")
    hits = hz.significant(fx.variants)
    line = F.format_string("  %s   %d %s ", "snp", "bp", F.col("beta").cast("string"))
    hits.select(F.concat(F.lit("chr"), F.col("chr").cast("string")).alias("part"), line.alias("value")) \
        .write.partitionBy("part").text(path)
    rows = rd.read_signal_tables(fx.spark, f"{path}/*/*.txt", ["SNP", "bp", "beta"])
    return rows.select("SNP", F.col("bp").cast("long").alias("bp"), F.round(F.col("beta").cast("double"), 6).alias("beta"), "CHR")


@query("ld_file_roundtrip", """
select cast(a.s_suppkey//10 as int) as region, 'v'||cast(a.s_suppkey as varchar) as i, 'v'||cast(b.s_suppkey as varchar) as j,
  case when (a.s_suppkey+b.s_suppkey)%11=0 then 0 else round(1.0::double/(1+abs(a.s_suppkey-b.s_suppkey)),6) end as r
from supplier a join supplier b on b.s_suppkey//10=a.s_suppkey//10""")
def _(fx):
    # one 10 x 10 matrix per block of ten suppliers, one file per matrix
    path = scratch_path(fx.spark, "ld")
    k = F.col("s_suppkey")
    region = F.floor(k / 10).cast("int")
    cell = lambda step: F.when((k + region * 10 + step) % 11 == 0, F.lit("nan")).otherwise(
        F.round(F.lit(1.0) / (1 + F.abs(k - region * 10 - step)), 6).cast("string"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), cell), "\t")
    rows = fx.supplier.select(region.alias("region"), k, F.concat(F.lit("v"), k.cast("string")).alias("label"), line.alias("value"))
    # many small files: tasks share them and move their own to the place, else the driver moves one after the other
    rows = spread(rows, "region", times=1).sortWithinPartitions("region", "s_suppkey")
    files = lambda value: rows.select("region", value).write.partitionBy("region").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    files("value").text(f"{path}/m")
    files(F.col("label").alias("value")).text(f"{path}/l")
    return rd.read_ld_matrix(fx.spark, f"{path}/m", f"{path}/l")


@query("peak_to_bed", with_views("peaks", """
select 'chr'||cast(chr as varchar) as chr, start_bp as start, end_bp as "end" from peaks"""))
def _(fx):
    path = scratch_path(fx.spark, "bed")
    wr.write_bed(fx.peaks.select(
        F.concat(F.lit("chr"), F.col("chr").cast("string")).alias("seqnames"), F.col("start_bp").alias("start"),
        F.col("end_bp").alias("end"), "cell_type"), path)
    return fx.spark.read.schema("chr string, start bigint, end bigint").option("sep", "\t").csv(path)


def _fact_text(fx, path):
    g = lambda: F.lower("gene_id")
    c = F.col("chr").cast("string")
    node = fx.genes.select(F.format_string("gene(%s).", g()).alias("value"))
    props = fx.genes.select(F.format_string("chr(gene(%s), chr%s).", g(), c).alias("value")).union(
        fx.genes.select(F.format_string("gene_name(gene(%s), %s).", g(), F.lower("symbol"))))
    ids = fx.genes.select("gene_key", g().alias("gid"))
    edges = fx.evidence.join(ids, "gene_key").select(
        F.format_string("%s(snp(%s), gene(%s)).", "pred", "snp", "gid").alias("value"))
    node.union(props).write.text(f"{path}/nodes")
    edges.write.text(f"{path}/edges")


@query("facts_loader", with_views("variants genes evidence", """
select e.pred, 'snp' as src_type, e.snp as src_id, 'gene' as dst_type, lower(g.gene_id) as dst_id
from evidence e join genes g on g.gene_key=e.gene_key"""))
def _(fx):
    path = scratch_path(fx.spark, "facts")
    _fact_text(fx, path)
    edges = kb.load_sources(fx.spark, {"gtex": {"path": path, "nodes": True, "edges": True}}, ["gtex"])
    kb.save_edges(edges, f"{path}/parquet")
    stored = fx.spark.read.parquet(f"{path}/parquet").filter(F.col("pred").isin("eqtl_association", "activity_by_contact"))
    return stored.select("pred", "src_type", "src_id", "dst_type", "dst_id")


@query("fact_properties", with_views("genes", """
select 'chr' as prop, 'gene' as type, lower(gene_id) as id, 'chr'||cast(chr as varchar) as value from genes
union all select 'gene_name', 'gene', lower(gene_id), lower(symbol) from genes"""))
def _(fx):
    path = scratch_path(fx.spark, "facts")
    _fact_text(fx, path)
    return kb.read_properties(fx.spark, f"{path}/nodes")


@query("chromosome_background", with_views("variants genes evidence", """
select e.pred, e.snp as src_id, lower(g.gene_id) as dst_id from evidence e join genes g on g.gene_key=e.gene_key where g.chr=16"""))
def _(fx):
    path = scratch_path(fx.spark, "facts")
    _fact_text(fx, path)
    edges = kb.read_edges(fx.spark, f"{path}/edges")
    props = kb.read_properties(fx.spark, f"{path}/nodes")
    return kb.chromosome_background(edges, props, "chr16", on="dst_id").select("pred", "src_id", "dst_id")


@query("labelled_examples", with_views("variants genes", """
select cast(v.bp%5 as int) as fold, cast(v.bp as bigint) as example_id, lower(g.gene_id) as gene, v.snp, v.p<5e-8 as label,
  case when v.bp%10<2 then 'test' else 'train' end as split
from variants v join genes g on g.gene_key=v.gene_key"""))
def _(fx):
    path = scratch_path(fx.spark, "examples")
    pairs = fx.variants.join(fx.genes.select("gene_key", F.lower("gene_id").alias("gid")), "gene_key").select(
        (F.col("bp") % 5).alias("fold"), "bp", "gid", "snp", (F.col("p") < 5e-8).alias("label"))
    goal = F.format_string("relevant_gene(%d, gene(%s), snp(%s))", "bp", "gid", "snp")
    text = F.when(F.col("label"), F.concat(goal, F.lit("."))).otherwise(F.concat(F.lit("neg("), goal, F.lit(").")))
    pairs.select("fold", text.alias("value")).write.partitionBy("fold").text(f"{path}/models")
    ids = pairs.select("fold", F.when(F.col("bp") % 10 < 2, "test").otherwise("train").alias("split"), F.col("bp").cast("string").alias("value"))
    for s in ("train", "test"):
        ids.filter(F.col("split") == s).select("fold", "value").distinct().write.partitionBy("fold").text(f"{path}/{s}_models")
    examples = kb.read_examples(fx.spark, f"{path}/models/*/*.txt")
    splits = _fold_rows(fx, path, "train").union(_fold_rows(fx, path, "test"))
    return examples.join(splits, ["fold", "example_id"]).select("fold", "example_id", "gene", "snp", "label", "split")


def _fold_rows(fx, path, split):
    rows = kb.read_fold_ids(fx.spark, f"{path}/{split}_models/*/*.txt")
    return rows.withColumn("split", F.lit(split)).select("fold", "example_id", "split")


@query("obo_loader", """
select 'GO:'||lpad(cast(p_partkey as varchar),7,'0') as id, p_name as name, p_brand||' '||p_type as "desc" from part""")
def _(fx):
    path = scratch_path(fx.spark, "obo")
    lines = F.concat_ws("\n", F.lit("[Term]"), F.concat(F.lit("id: GO:"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")),
                        F.concat(F.lit("name: "), "p_name"), F.lit("namespace: biological_process"),
                        F.concat(F.lit('def: "'), "p_brand", F.lit(" "), "p_type", F.lit('" [src]')))
    fx.part.select(lines.alias("value")).write.option("lineSep", "\n\n").text(path)
    return rd.read_obo(fx.spark, path)


@query("descendants_loader", """
select 'U:'||cast(l_orderkey as varchar) as parent, 'U:'||cast(l_partkey as varchar) as descendant from lineitem""")
def _(fx):
    path = scratch_path(fx.spark, "tissue")
    name = lambda c: F.concat(F.lit("U:"), F.col(c).cast("string"))
    # one order is one parent with its few lines as descendants
    maps = fx.lineitem.groupBy(name("l_orderkey").alias("parent")).agg(F.collect_list(name("l_partkey")).alias("kids"))
    maps.select(F.to_json(F.create_map("parent", "kids")).alias("value")).write.text(path)
    return rd.read_descendants(fx.spark, path)


@query("documents_json", """
select c.c_custkey as id, c.c_mktsegment as phenotype, o.o_orderkey as enrich_id, o.o_orderpriority as status, round(o.o_totalprice,2) as score
from customer c join orders o on o.o_custkey=c.c_custkey""")
def _(fx):
    path = scratch_path(fx.spark, "docs")
    docs = fx.orders.join(fx.customer, fx.orders.o_custkey == fx.customer.c_custkey).select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("phenotype"),
        F.struct(F.col("o_orderkey").alias("enrich_id"), F.col("o_orderpriority").alias("status"), F.col("o_totalprice").alias("score")).alias("state"))
    wr.write_json(docs, path)
    schema = "id bigint, phenotype string, state struct<enrich_id:bigint,status:string,score:double>"
    return rd.read_documents(fx.spark, path, schema).select(
        "id", "phenotype", "state.enrich_id", "state.status", F.round("state.score", 2).alias("score"))


@query("track_json", with_views("tfbs", """
select 'chr'||cast(chr as varchar)||'_'||cast(t_start as varchar)||'_'||cast(t_end as varchar)||'_grch38' as id,
  'chr'||cast(chr as varchar) as chr, t_start as start, t_end as "end", 'ctcf' as tf from tfbs where tfbs_key%3=0"""))
def _(fx):
    path = scratch_path(fx.spark, "track")
    site = F.struct(
        F.concat(F.lit("chr"), F.col("chr").cast("string")).alias("chrom"), F.col("t_start").alias("chromStart"),
        F.col("t_end").alias("chromEnd"), F.when(F.col("tfbs_key") % 3 == 0, "CTCF").otherwise("YY1").alias("name"))
    # one response per 50 kb window, as the service would answer
    windows = fx.tfbs.groupBy("chr", F.floor(F.col("t_start") / 50000)).agg(F.collect_list(site).alias("encRegTfbsClustered"))
    windows.select(F.to_json(F.struct("encRegTfbsClustered")).alias("value")).write.text(path)
    return rd.read_track_json(fx.spark, path, "encRegTfbsClustered", "ctcf")


@query("annotated_variants", with_views("variants", """
select 'chr'||cast(chr as varchar) as chrom, bp as pos, a2 as ref, a1 as alt, case when l_linestatus='O' then 'Y' else null end as coding,
  round(frq,4) as vest_score, snp as hugo from variants"""))
def _(fx):
    path = scratch_path(fx.spark, "cravat")
    none = F.lit(None).cast("string")
    fx.variants.select(
        F.concat(F.lit("chr"), F.col("chr").cast("string")).alias("chrom"), "bp", "a2", "a1",
        F.when(F.col("l_linestatus") == "O", "Y").alias("coding"), F.col("snp").alias("hugo"), none.alias("so"),
        "frq", none.alias("vp"), none.alias("ss"), none.alias("sp"),
    ).write.option("sep", "\t").csv(path)
    rows = rd.read_annotated_variants(fx.spark, path)
    return rows.select("chrom", "pos", "ref", "alt", "coding", F.round("vest_score", 4).alias("vest_score"), "hugo")


@query("side_by_side", """
select o_orderkey as id, o_orderpriority as description, cast(o_custkey as varchar) as ground_truth_gene_id from orders""")
def _(fx):
    path = scratch_path(fx.spark, "pairs")
    rows = fx.orders.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey")
    rows.select("o_orderkey", "o_orderpriority").write.option("sep", "\t").csv(f"{path}/data")
    rows.select(F.col("o_custkey").cast("string")).write.option("sep", "\t").csv(f"{path}/labels")
    data = fx.spark.read.schema("id bigint, description string").option("sep", "\t").csv(f"{path}/data")
    labels = fx.spark.read.schema("gene_id string").option("sep", "\t").csv(f"{path}/labels")
    return rd.side_by_side(data, labels, {"gene_id": "ground_truth_gene_id"})


@query("ranked_list_sink", """
select p_name||'_'||cast(p_partkey as varchar) as symbol, cast(p_retailprice as decimal(12,4))::varchar as score from part""")
def _(fx):
    path = scratch_path(fx.spark, "ranked")
    named = fx.part.select(F.concat_ws("_", "p_name", F.col("p_partkey").cast("string")).alias("symbol"), "p_retailprice")
    wr.write_ranked_list(named, path, "symbol", "p_retailprice")
    return fx.spark.read.schema("symbol string, score string").option("sep", "\t").csv(path)


@query("passage_corpus_reader", """
select lang||'-'||cast(doc_id as varchar) as title, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from documents
where trim(regexp_replace(text, '\\s+', ' ', 'g'))<>''""")
def _(fx):
    path = scratch_path(fx.spark, "corpus")
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    fx.documents.select(F.concat_ws("-", "lang", F.col("doc_id").cast("string")).alias("title"), text.alias("text")) \
        .filter("text <> ''").write.option("sep", "\t").csv(path)
    return rd.read_passages(fx.spark, path)


@query("pending_work", with_views("peaks", """
select distinct cell_type, chr from peaks except select distinct cell_type, chr from peaks where start_bp%3=0"""))
def _(fx):
    work = fx.peaks.select("cell_type", "chr").distinct()
    return wr.pending(work, fx.peaks.filter("start_bp % 3 = 0"), ["cell_type", "chr"])


@query("file_stems", """
select distinct source||'/'||lang||'.tsv.bgz' as path, lang as stem from documents""")
def _(fx):
    path = F.concat("source", F.lit("/"), "lang", F.lit(".tsv.bgz"))
    return fx.documents.select(path.alias("path"), C.file_stem(path).alias("stem")).distinct()


@query("node_facts", with_views("genes", "select 'gene' as type, lower(gene_id) as id from genes union all select 'snp', 'rs'||cast(gene_key as varchar) from genes"))
def _(fx):
    path = scratch_path(fx.spark, "nodes")
    fact = lambda kind, id_: F.format_string(f"{kind}(%s).", id_)
    genes = fx.genes.select(fact("gene", F.lower("gene_id")).alias("value"))
    genes.union(fx.genes.select(fact("snp", F.concat(F.lit("rs"), F.col("gene_key").cast("string"))))).write.text(path)
    return kb.read_nodes(fx.spark, path)
