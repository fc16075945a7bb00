"""Queries on summary statistics: filters, quality rules, lookups and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusloom.functions import columns as C
from locusloom.operators import evidence as ev
from locusloom.operators import harmonise as hz
from locusloom.plans.fixtures import with_views
from locusloom.plans.registry import query


@query("significant_variants", with_views("variants", """
select cast(chr as varchar)||':'||cast(bp as varchar)||':'||a2||':'||a1 as id, snp, chr, bp, round(mlog10p,6) as mlog10p
from variants where p<5e-8"""))
def _(fx):
    hits = hz.significant(fx.variants)
    return hits.select(
        C.variant_id(F.col("chr"), F.col("bp"), F.col("a2"), F.col("a1")).alias("id"), "snp", "chr", "bp",
        F.round("mlog10p", 6).alias("mlog10p"),
    )


def raw_sumstats(fx):
    """Variants under foreign headers and as text, with some bad rows."""
    return fx.variants.select(
        F.concat(F.lit("chr"), F.col("chr").cast("string")).alias("CHROM"), F.col("bp").cast("string").alias("POSITION"),
        F.col("snp").alias("rsID"), F.lower("a1").alias("Effect_Allele"),
        F.when(F.col("bp") % 50 == 0, F.concat("a2", F.lit("TT"))).otherwise(F.col("a2")).alias("Other_Allele"),
        F.when(F.col("bp") % 41 == 0, F.lit("n/a")).otherwise(F.col("beta").cast("string")).alias("BETA"),
        F.when(F.col("bp") % 43 == 0, F.lit("0")).otherwise(F.col("se").cast("string")).alias("STDERR"),
        F.when(F.col("bp") % 47 == 0, F.lit("1.5")).otherwise(F.round("mlog10p", 3).cast("string")).alias("score"),
        F.when(F.col("bp") % 47 == 0, F.lit("1.5")).otherwise((F.col("mlog10p") / 20).cast("string")).alias("p_value"),
        F.col("n").cast("string").alias("NEFF"),
    )


_RAW = """
  raw as (select chr, bp as pos, snp, a1, case when bp%50=0 then a2||'TT' else a2 end as a2,
     case when bp%41=0 then null else beta end as beta, case when bp%43=0 then 0 else se end as se,
     case when bp%47=0 then 1.5::double else mlog10p/20 end as p, n from variants)"""


@query("harmonised_columns", with_views("variants", f"""with {_RAW}
select chr, pos, snp, a1, a2, round(beta,6) as beta, round(se,6) as se, round(p,6) as p, n from raw where beta is not null"""))
def _(fx):
    rows = hz.drop_missing(hz.coerce(hz.canonical_columns(raw_sumstats(fx))))
    return rows.select("chr", "pos", "snp", "a1", "a2", *[F.round(c, 6).alias(c) for c in ("beta", "se", "p")], "n")


@query("munge_sumstats", with_views("variants", f"""with {_RAW},
  kept as (select * from raw where beta is not null and p between 0 and 1 and se>0 and length(a2)=1 and a1<>a2),
  by_id as (select * from (select *, row_number() over (partition by snp order by p, pos) as r from kept) t where r=1),
  by_place as (select * from (select *, row_number() over (partition by chr, pos order by p, snp) as r2 from by_id) t where r2=1)
select snp, cast(chr as varchar)||':'||cast(pos as varchar)||':'||a2||':'||a1 as id, round(beta/se,6) as z, n from by_place"""))
def _(fx):
    return hz.munge(raw_sumstats(fx)).select("snp", "id", F.round("z", 6).alias("z"), "n")


@query("variant_labels", with_views("variants", """
select cast(chr as varchar)||':'||cast(bp as varchar)||'-'||cast(bp+1 as varchar)||'-'||a2||'>'||a1 as label, chr, bp, a2, a1
from variants where snp not like '%7'"""))
def _(fx):
    ids = fx.variants.select(
        F.when(F.col("snp").endswith("7"), F.concat_ws(":", F.lit("X"), F.col("snp")))
        .otherwise(C.variant_id(F.col("chr"), F.col("bp"), F.col("a2"), F.lower("a1"))).alias("id")
    )
    v = ids.select(C.parsed_variant_id(F.col("id")).alias("v")).filter(F.col("v").isNotNull()).select("v.*")
    label = C.variant_label(F.col("chr"), F.col("bp"), F.col("bp") + 1, F.col("a2"), F.col("a1"))
    return v.select(label.alias("label"), "chr", "bp", "a2", F.upper("a1").alias("a1"))


@query("hm3_merge", with_views("variants", """
with hm as (select snp, a2 as h1, a1 as h2 from variants where bp%3=0)
select v.snp, v.a1, v.a2, round(beta/se,6) as z, n from variants v join hm on hm.snp=v.snp and (v.a1=h1 or v.a1=h2)
where least(a1,a2)||greatest(a1,a2) not in ('AT','CG') and se<>0"""))
def _(fx):
    listed = fx.variants.filter("bp % 3 = 0").select("snp", F.col("a2").alias("a1"), F.col("a1").alias("a2"))
    return hz.ldsc_table(fx.variants, listed).withColumn("z", F.round("z", 6))


def _bim(fx):
    return fx.variants.filter("bp % 4 <> 0").select("snp", "chr", F.col("bp").alias("pos"))


@query("position_lookup", with_views("variants", """
with bim as (select snp, chr, bp as pos from variants where bp%4<>0
   union all select snp, chr, bp+10 from variants where bp%8=1)
select v.snp, round(v.beta,4) as beta, min(b.chr) as chr, min(b.pos) as pos from variants v join bim b on b.snp=v.snp group by 1,2"""))
def _(fx):
    again = fx.variants.filter("bp % 8 = 1").select("snp", "chr", (F.col("bp") + 10).alias("pos"))
    found = hz.position_lookup(fx.variants.select("snp", F.round("beta", 4).alias("beta")), _bim(fx).union(again))
    return found.select("snp", "beta", "chr", "pos")


@query("panel_presence", with_views("variants", """
select chr, count_if(bp%4<>0)::bigint as kept, count_if(bp%4=0)::bigint as missing from variants group by chr"""))
def _(fx):
    kept = hz.in_panel(fx.variants, _bim(fx)).groupBy("chr").agg(F.count("*").alias("kept"))
    gone = hz.in_panel(fx.variants, _bim(fx), missing=True).groupBy("chr").agg(F.count("*").alias("missing"))
    zero = F.lit(0).cast("long")
    return kept.join(gone, "chr", "full").select(
        "chr", F.coalesce("kept", zero).alias("kept"), F.coalesce("missing", zero).alias("missing")
    )


_VEST = "case when bp%11=0 then null else (bp%100)/100.0::double end"
_SIFT = "case when bp%13=0 or bp%11=0 then null else (bp%60)/1000.0::double end"


@query("impact_class", with_views("variants", f"""
with s as (select snp, {_VEST} as vest, {_SIFT} as sift from variants),
 d as (select *, coalesce(vest>0.5,false) or coalesce(sift<0.05,false) as is_damaging,
   coalesce(vest>0.8,false) and coalesce(sift<0.01,false) as agree from s)
select snp, is_damaging, case when vest is null and sift is null then 'no_data' when is_damaging and agree then 'high'
  when is_damaging then 'medium' else 'low' end as confidence from d"""))
def _(fx):
    return annotated(fx).select("snp", "impact.is_damaging", "impact.confidence")


def annotated(fx):
    """Annotated-variant rows in the shape the coding-effect rules read."""
    bp = F.col("bp")
    vest = F.when(bp % 11 != 0, (bp % 100) / F.lit(100.0))
    sift = F.when((bp % 13 != 0) & (bp % 11 != 0), (bp % 60) / F.lit(1000.0))
    return fx.variants.select(
        "snp", F.format_string("chr%d_%d_%s_%s", "chr", "bp", F.lower("a2"), F.lower("a1")).alias("variant"),
        F.when(F.col("l_linestatus") == "O", "coding").otherwise("noncoding").alias("status"),
        F.col("gene_key").alias("__g"), C.impact(vest, sift).alias("impact"),
    )


@query("coding_effect", with_views("variants genes", f"""
select v.snp, 'chr'||cast(v.chr as varchar)||'_'||cast(bp as varchar)||'_'||lower(a2)||'_'||lower(a1) as variant, g.gene_id,
  coalesce({_VEST}>0.5,false) or coalesce({_SIFT}<0.05,false) as is_damaging
from variants v join genes g on g.gene_key=v.gene_key where v.l_linestatus='O' and v.gene_key%7<>0"""))
def _(fx):
    names = fx.genes.select(F.col("gene_key").alias("__g"), F.when(F.col("gene_key") % 7 != 0, F.lower("symbol")).alias("hugo"))
    rows = annotated(fx).join(names, "__g").drop("__g")
    out = ev.coding_effect(rows, fx.genes).join(fx.genes.select("gene_key", "gene_id"), "gene_key")
    return out.select("snp", "variant", "gene_id", "impact.is_damaging")


@query("motif_gain_loss", with_views("variants", """
with m as (select snp as variant, 'ctcf' as tf, beta as score from variants union all
  select snp, 'yy1', frq-0.21 from variants union all select snp, 'sp1', se-0.01 from variants)
select variant, tf, round(score,6) as score, case when score<0 then 'loss' else 'gain' end as type from m where score<>0"""))
def _(fx):
    matrix = fx.variants.select(
        "snp", F.col("beta").alias("CTCF_HUMAN.H11"), (F.col("frq") - F.lit(0.21)).alias("YY1_HUMAN.H11"),
        (F.col("se") - F.lit(0.01)).alias("SP1_HUMAN.H11"),
    )
    long = hz.motif_long(matrix, "snp", ["`CTCF_HUMAN.H11`", "`YY1_HUMAN.H11`", "`SP1_HUMAN.H11`"])
    return long.withColumn("score", F.round("score", 6))


@query("motif_facts", with_views("variants genes", """
select v.snp as variant, g.gene_key, round(v.beta,6) as score, case when v.beta<0 then 'loss' else 'gain' end as type
from variants v join genes g on g.gene_key=v.gene_key where v.beta<>0 and v.gene_key%3<>0"""))
def _(fx):
    symbols = fx.genes.select("gene_key", F.when(F.col("gene_key") % 3 != 0, F.upper("symbol")).otherwise("?").alias("tf"))
    motifs = fx.variants.filter("beta <> 0").join(symbols, "gene_key").select(
        F.col("snp").alias("variant"), "tf", F.round("beta", 6).alias("score"),
        F.when(F.col("beta") < 0, "loss").otherwise("gain").alias("type"),
    )
    return ev.symbol_facts(motifs, fx.genes, "tf").select("variant", "gene_key", "score", "type")


@query("name_sanitise", """
with n as (select p_partkey, p_name||case when p_partkey%2=0 then ' (' else '/(' end||cast(p_partkey//3 as varchar)||')' as raw from part),
 u as (select distinct raw from n),
 s as (select raw, regexp_replace(raw,'[^A-Za-z0-9_-]','_','g') as safe from u),
 k as (select raw, safe, row_number() over (partition by safe order by raw) as k from s)
select raw, case when k>1 then safe||'_'||cast(k as varchar) else safe end as safe,
  replace(replace(raw,' (','_('),'_(','_') as dummy from k""".replace(
    "replace(replace(raw,' (','_('),'_(','_') as dummy", "replace(replace(replace(raw,' ','_'),'_(','_'),')','') as tissue"))
def _(fx):
    raw = F.concat(
        "p_name", F.when(F.col("p_partkey") % 2 == 0, " (").otherwise("/("),
        F.floor(F.col("p_partkey") / 3).cast("string"), F.lit(")"),
    )
    names = fx.part.select(raw.alias("raw")).distinct()
    out = hz.unique_safe_names(names, "raw", "safe")
    return out.select("raw", "safe", C.tissue_label(F.replace("raw", F.lit(" "), F.lit("_"))).alias("tissue"))


@query("sample_size_resolve", """
select o_orderkey, case when o_orderkey%5=0 then 10000+o_orderkey when o_orderkey%5=1 then 20000+o_orderkey
  when o_orderkey%5=2 then 30000+o_orderkey when o_orderkey%5=3 then 40000+o_orderkey else 807553 end as n from orders""")
def _(fx):
    k = F.col("o_orderkey")
    val = lambda base: (k + base).cast("string")
    metadata = (
        F.when(k % 5 == 1, F.concat(F.lit('{"study":{"n":0,"groups":[{"x":1},{"N":'), val(20000), F.lit("}]}}")))
        .when(k % 5 == 2, F.concat(F.lit('{"a":{"n":7},"Sample_Size":'), val(30000), F.lit("}")))
        .when(k % 5 == 3, F.concat(F.lit('{"samples":[{"sample-size":'), val(40000), F.lit("}]}")))
        .when(k % 5 == 4, F.lit('{"name":"n","list":[1,2]}'))
    )
    column_n = F.when(k % 5 == 0, k + 10000)
    return fx.orders.select("o_orderkey", hz.resolve_sample_size(column_n, metadata).alias("n"))


@query("run_param_check", """
with r as (select o_orderkey as run, case when o_orderkey%3=0 then 'GRCh37' when o_orderkey%3=1 then 'GRCh38' else 'hg19' end as ref_genome,
  case when o_orderkey%4=3 then 'XXX' else 'EUR' end as population, o_orderkey%20 as max_workers, (o_orderkey%7)/10.0::double as maf,
  o_orderkey as seed, o_orderkey%12000 as win, o_orderkey%53-1 as l, (o_orderkey%110)/100.0::double as coverage,
  (o_orderkey%13)/10.0::double as mac, o_orderkey%22 as bs from orders)
select run, array_to_string(list_filter([case when ref_genome not in ('GRCh37','GRCh38') then 'ref_genome' end,
  case when population not in ('EUR','AFR','AMR','EAS','SAS') then 'population' end,
  case when max_workers not between 1 and 16 then 'max_workers' end, case when maf not between 0.001 and 0.5 then 'maf' end,
  case when seed not between 1 and 999999 then 'seed' end, case when win>10000 then 'window' end,
  case when l<>-1 and l not between 1 and 50 then 'l' end, case when coverage not between 0.5 and 0.999 then 'coverage' end,
  case when mac not between 0.5 and 1.0 then 'min_abs_corr' end, case when bs not between 1 and 20 then 'batch_size' end],
  lambda x: x is not null), ',') as reasons from r""")
def _(fx):
    k = F.col("o_orderkey")
    runs = fx.orders.select(
        k.alias("run"), F.when(k % 3 == 0, "GRCh37").when(k % 3 == 1, "GRCh38").otherwise("hg19").alias("ref_genome"),
        F.when(k % 4 == 3, "XXX").otherwise("EUR").alias("population"), (k % 20).alias("max_workers"),
        ((k % 7) / F.lit(10.0)).alias("maf"), k.alias("seed"), (k % 12000).alias("window"), (k % 53 - 1).alias("l"),
        ((k % 110) / F.lit(100.0)).alias("coverage"), ((k % 13) / F.lit(10.0)).alias("min_abs_corr"),
        (k % 22).alias("batch_size"),
    )
    return runs.select("run", F.array_join(hz.run_problems(), ",").alias("reasons"))
