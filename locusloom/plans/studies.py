"""Queries that chain the steps of a study, and inputs with gaps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from locusloom.functions import columns as C
from locusloom.functions.session import saved, scratch_path
from locusloom.operators import alignment as al
from locusloom.operators import evidence as ev
from locusloom.operators import finemap as fm
from locusloom.operators import harmonise as hz
from locusloom.operators import intervals as iv
from locusloom.plans.fixtures import with_views
from locusloom.plans.registry import query
from locusloom.sources import readers as rd
from locusloom.sources import writers as wr


def _study(fx, snp=None, pos=None):
    """Variants under a consortium's headers."""
    return fx.variants.select(
        F.col("chr").cast("string").alias("#CHROM"), (F.col("bp") if pos is None else pos).alias("POS"),
        (F.col("snp") if snp is None else snp).alias("rsID"), F.lower("a1").alias("effect_allele"), F.lower("a2").alias("other_allele"),
        F.col("beta").alias("BETA"), F.col("se").alias("SE"), F.col("p").alias("P"), F.col("n").alias("N"), F.col("frq").alias("EAF"))


_GAPS = """
  raw as (select chr, case when bp%11=0 then null else bp end as pos, case when bp%7=0 then null else snp end as snp, a1, a2, beta, se, p, n, frq from variants),
  kept as (select * from raw where p between 0 and 1 and se>0 and a1<>a2),
  by_id as (select * from kept where snp is null union all
    select chr, pos, snp, a1, a2, beta, se, p, n, frq from (select *, row_number() over (partition by snp order by p, pos nulls first) as r from kept where snp is not null) t where r=1),
  by_place as (select * from by_id where pos is null union all
    select chr, pos, snp, a1, a2, beta, se, p, n, frq from (select *, row_number() over (partition by chr, pos order by p, snp nulls first) as r from by_id where pos is not null) t where r=1)"""


@query("munge_missing_ids", with_views("variants", f"""with {_GAPS}
select chr, pos, snp, cast(chr as varchar)||':'||cast(pos as varchar)||':'||a2||':'||a1 as id, round(beta/se,6) as z, frq, n from by_place"""))
def _(fx):
    bp = F.col("bp")
    raw = _study(fx, F.when(bp % 7 == 0, None).otherwise(F.col("snp")), F.when(bp % 11 == 0, None).otherwise(bp))
    names = {"#CHROM": "CHROM"}
    return hz.munge(raw.withColumnsRenamed(names)).select("chr", "pos", "snp", "id", F.round("z", 6).alias("z"), "frq", "n")


@query("sex_chromosomes", with_views("variants", """
select snp, case chr when 22 then 23 when 21 then 24 when 20 then 25 when 19 then 26 when 18 then null else chr end as code,
  case when chr<>18 then cast(case chr when 22 then 23 when 21 then 24 when 20 then 25 when 19 then 26 else chr end as varchar)||':'||cast(bp as varchar)||':'||a2||':'||a1 end as id
from variants"""))
def _(fx):
    c = F.col("chr")
    text = (F.when(c == 22, "chrX").when(c == 21, "y").when(c == 20, " XY").when(c == 19, "chrMT").when(c == 18, "scaffold_1").otherwise(c.cast("string")))
    code = C.chromosome(text)
    return fx.variants.select("snp", code.alias("code"), C.variant_id(code, F.col("bp"), F.col("a2"), F.col("a1")).alias("id"))


@query("sumstats_mixed_headers", with_views("variants", """
select snp, chr, bp as pos, a1, a2, round(beta,6) as beta, case when chr%3=1 then null else round(se,6) end as se from variants"""))
def _(fx):
    root = scratch_path(fx.spark, "mixed")
    v = fx.variants
    full = v.select(F.col("snp").alias("SNP"), F.col("chr").alias("CHR"), F.col("bp").alias("BP"), "a1", "a2", "beta", "se", F.col("p").alias("P"))
    turned = v.select(F.col("p").alias("P"), "a2", "a1", "beta", F.col("bp").alias("BP"), F.col("chr").alias("CHR"), F.col("snp").alias("SNP"))
    wr.write_table(full.filter("chr % 3 = 0"), f"{root}/a")
    wr.write_table(turned.filter("chr % 3 = 1"), f"{root}/b")
    wr.write_table(full.filter("chr % 3 = 2"), f"{root}/c")
    back = hz.coerce(hz.canonical_columns(rd.read_sumstats(fx.spark, f"{root}/*")))
    return back.select("snp", "chr", "pos", "a1", "a2", F.round("beta", 6).alias("beta"), F.round("se", 6).alias("se"))


@query("rs_id_choice", with_views("variants", "select snp as id, snp as rs_id from variants"))
def _(fx):
    named = fx.variants.select(F.col("snp").alias("RSID"), "chr")
    return named.select(F.col("RSID").alias("id"), hz.rs_id(named.columns).alias("rs_id"))


@query("study_sample_sizes", """
select o_custkey, case when count(*)>3 then max(o_orderkey) else any_value(case when o_custkey%2=0 then 5000+o_custkey else 807553 end) end as n
from (select *, count(*) over (partition by o_custkey) as k from orders) t group by o_custkey""")
def _(fx):
    few = F.count("*").over(Window.partitionBy("o_custkey")) > 3
    stats = fx.orders.select("o_custkey", F.when(few, F.col("o_orderkey")).cast("string").alias("Sample_Size"))
    text = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit('{"N":'), (F.col("o_custkey") + 5000).cast("string"), F.lit("}")))
    metadata = fx.orders.select("o_custkey").distinct().withColumn("metadata", text)
    return hz.study_sample_sizes(stats, ["o_custkey"], metadata)


_PANEL = """
  st as (select 'chr'||cast(chr as varchar)||':'||cast(cast(floor(bp/1000000) as bigint) as varchar) as region_id, * from variants),
  pn as (select distinct region_id, chr, bp, case when bp%3=0 then a2 else a1 end as a1, case when bp%3=0 then a1 else a2 end as a2 from st where l_linestatus='O' and a1<>a2),
  nm as (select *, cast(chr as varchar)||':'||cast(bp as varchar)||':'||a2||':'||a1 as id from pn),
  ln as (select *, row_number() over (partition by region_id order by bp, id)-1 as panel_place from nm),
  mt as (select ln.region_id, ln.panel_place, ln.id, case when st.a1=ln.a1 then 1 else -1 end as sign, st.snp, st.beta from st join ln on ln.region_id=st.region_id and ln.chr=st.chr and ln.bp=st.bp
    and ((ln.a1=st.a1 and ln.a2=st.a2) or (ln.a1=st.a2 and ln.a2=st.a1)))"""


@query("ld_alignment", with_views("variants", f"""with {_PANEL},
  one as (select * from mt qualify count(*) over (partition by region_id, panel_place, sign)=1)
select region_id, row_number() over (partition by region_id order by panel_place, sign desc)-1 as place, panel_place, id, snp, round(sign*beta,6) as beta from one"""))
def _(fx):
    """Positions with one variant per orientation, so that the order is total."""
    locus = F.concat(F.lit("chr"), F.col("chr").cast("string"), F.lit(":"), F.floor(F.col("bp") / 1_000_000).cast("string"))
    stats = fx.variants.withColumn("region_id", locus)
    flip = F.col("bp") % 3 == 0
    panel = stats.filter("l_linestatus = 'O' and a1 <> a2").select(
        "region_id", "chr", "bp", F.when(flip, F.col("a2")).otherwise(F.col("a1")).alias("a1"), F.when(flip, F.col("a1")).otherwise(F.col("a2")).alias("a2")).distinct()
    once = Window.partitionBy("region_id", "chr", "bp", "a1", "a2")
    single = stats.withColumn("__n", F.count("*").over(once)).filter("__n = 1")
    out = al.align_to_panel(single, panel, ["snp", "beta"])
    return out.select("region_id", "place", "panel_place", "id", "snp", F.round(F.col("sign") * F.col("beta"), 6).alias("beta"))


_CHAIN = """
  kept as (select * from variants where p between 0 and 1 and se>0 and a1<>a2),
  by_id as (select * from (select *, row_number() over (partition by snp order by p, bp) as r from kept) t where r=1),
  mg as (select * from (select *, row_number() over (partition by chr, bp order by p, snp) as r2 from by_id) t where r2=1),
  ld as (select * from (select *, row_number() over (partition by chr, cast(floor(bp/1000000) as bigint) order by p, snp) as r3 from mg where p<5e-8) t where r3=1),
  mb as (select 'chr'||cast(l.chr as varchar)||':'||cast(l.bp as varchar) as region_id, m.snp, m.chr, m.bp, m.beta/m.se as z, m.se, m.p, m.n from ld l join mg m on m.chr=l.chr and m.bp between l.bp-500000 and l.bp+500000),
  en as (select * from mb where region_id in (select region_id from mb group by 1 having count(*)>=2)),
  lb as (select *, 0.5*ln(se*se/(se*se+0.04::double))+0.5*z*z*0.04::double/(se*se+0.04::double) as lbf from en),
  mx as (select *, exp(lbf-max(lbf) over (partition by region_id)) as e from lb),
  pp as (select *, e/sum(e) over (partition by region_id) as pip from mx),
  cu as (select *, coalesce(sum(pip) over (partition by region_id order by round(lbf,9) desc, snp rows between unbounded preceding and 1 preceding),0) as before from pp),
  cs as (select * from cu where before<0.95)"""


def credible_sets(fx):
    """Raw statistics -> quality control -> significant variants -> leads -> windows -> probabilities -> credible sets; the
    sets and the leads."""
    clean = hz.munge(_study(fx).withColumnsRenamed({"#CHROM": "CHROM"})).withColumnRenamed("pos", "bp")
    clean = saved(clean.select("snp", "chr", "bp", "z", "se", "p", "n"), "clean")
    leads = ev.locus_leads(hz.significant(clean)).select(
        "chr", F.col("bp").alias("center"), F.concat(F.lit("chr"), F.col("chr").cast("string"), F.lit(":"), F.col("bp").cast("string")).alias("region_id"))
    members = iv.region_members(leads, clean, 500)
    return fm.credible_set(fm.abf_pips(members, ["region_id"]), ["region_id"], [F.round("lbf", 9).desc(), F.col("snp")]), leads


@query("gwas_to_credible_sets", with_views("variants", f"with {_CHAIN} select region_id, snp, round(z,6) as z, round(pip,6) as pip from cs"))
def _(fx):
    return credible_sets(fx)[0].select("region_id", "snp", F.round("z", 6).alias("z"), F.round("pip", 6).alias("pip"))


@query("gwas_summary", with_views("variants", f"""with {_CHAIN}
select count(*) as total_variants, count_if(pip>0.5)::bigint as high_confidence, 1 as max_credible_set, round(avg(abs(z)),6) as mean_abs_z, max(n) as max_n,
 count(distinct region_id) as regions_ok, (select count(*) from ld)-count(distinct region_id) as regions_failed from cs"""))
def _(fx):
    sets, leads = credible_sets(fx)
    sets = saved(sets.withColumn("cs", F.lit(1)), "sets")
    return fm.run_summary(sets, leads).withColumn("mean_abs_z", F.round("mean_abs_z", 6))
