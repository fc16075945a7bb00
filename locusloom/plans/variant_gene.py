"""Queries on variants, genes and the evidence rules between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.functions.running import shuffled
from locusloom.operators import evidence as ev
from locusloom.operators import intervals as iv
from locusloom.operators import proofs as pf
from locusloom.plans.fixtures import Fixtures, with_views
from locusloom.plans.registry import query

_NEAR = "abs(v.bp-g.g_start)<={k} or abs(v.bp-g.g_end)<={k}"
_NEAR_500K = _NEAR.format(k=500000)
_REG = """
  reg as (select distinct v.snp, a.gene_key from variants v
          join enhancers e on e.chr=v.chr and (abs(v.bp-e.e_start)<=50000 or abs(v.bp-e.e_end)<=50000)
          join associated_with a on a.enh_key=e.enh_key)"""
_REL = _REG + """,
  rel as (select snp, gene_key, 'regulatory_effect' as rule from reg
          union select snp, gene_key, pred from evidence)"""
_SCORE = _REL + """,
  score as (select snp, gene_key, 1-(case when max(case when rule='regulatory_effect' then 1 else 0 end)=1 then 0.66::double else 1 end)
      *(case when max(case when rule='eqtl_association' then 1 else 0 end)=1 then 0.9824::double else 1 end)
      *(case when max(case when rule='activity_by_contact' then 1 else 0 end)=1 then 0.979::double else 1 end) as score
    from rel group by 1,2)"""


def relevant(fx: Fixtures) -> DataFrame:
    return ev.relevant_gene(fx.variants, fx.enhancers, fx.associated_with, fx.evidence)


def _links_once(fx: Fixtures) -> Fixtures:
    """The variants that the enhancer rule and both direct rules read, computed once."""
    return fx.once("variants", "snp", "chr", "bp", "gene_key", "l_returnflag")


def placed_once(fx: Fixtures) -> Fixtures:
    """The variants that the domain rule and the distance rule read, computed once."""
    return fx.once("variants", "snp", "chr", "bp", "gene_key")


def closest(fx: Fixtures) -> DataFrame:
    return fx.variants.select("snp", "gene_key").join(shuffled(fx.genes.select("gene_key")), "gene_key", "left_semi")


def candidates(fx: Fixtures, column: str = "gene_key") -> DataFrame:
    return ev.candidate_genes(fx.variants, fx.genes, closest(fx), fx.tads, column)


@query("variant_to_gene", with_views("variants genes enhancers associated_with evidence", f"""
with lead as (select * from (select *, cast(floor(bp/1000000) as bigint) as locus,
      row_number() over (partition by chr, cast(floor(bp/1000000) as bigint) order by p, snp) as rn
      from variants where p<5e-8) t where rn=1),
  {_SCORE},
  near as (select v.snp, v.chr, v.locus, g.gene_key, g.gene_id from lead v join genes g on g.chr=v.chr and ({_NEAR_500K}))
select chr, locus, snp, gene_id, round(score,6) as score from (
  select n.*, coalesce(s.score,0) as score, row_number() over (partition by n.snp order by coalesce(s.score,0) desc, n.gene_id) as rn
  from near n left join score s on s.snp=n.snp and s.gene_key=n.gene_key) t where rn=1"""))
def flagship(fx: Fixtures) -> DataFrame:
    leads = ev.locus_leads(fx.variants.filter(F.col("p") < 5e-8)).select("snp", "chr", "bp", "locus")
    near = ev.near_genes(leads, fx.genes)
    # the rules run on the leads only: a far smaller left side for the enhancer range join
    facts = fx.evidence.join(leads.select("snp"), "snp", "left_semi")
    scores = ev.noisy_or(ev.relevant_gene(leads, fx.enhancers, fx.associated_with, facts))
    scored = (
        near.join(scores, ["snp", "gene_key"], "left")
        .join(shuffled(fx.genes.select("gene_key", "gene_id")), "gene_key")
        .withColumn("score", F.coalesce("score", F.lit(0.0)))
    )
    best = ev.best_gene(scored)
    return best.join(leads, "snp").select("chr", "locus", "snp", "gene_id", F.round("score", 6).alias("score"))


@query("within_k_distance", with_views("variants genes", f"""
select v.snp, g.gene_id from variants v join genes g on g.chr=v.chr and ({_NEAR_500K})"""))
def _(fx):
    near = ev.near_genes(fx.variants, fx.genes)
    return near.join(shuffled(fx.genes.select("gene_key", "gene_id")), "gene_key").select("snp", "gene_id")


@query("overlaps_with", with_views("tfbs genes", """
select t.tfbs_key, g.gene_id from tfbs t join genes g on g.chr=t.chr and g.g_start<t.t_start and t.t_end<g.g_end"""))
def _(fx):
    pairs = iv.contained_in(
        fx.tfbs, fx.genes.select("gene_id", "chr", "g_start", "g_end"), "t_start", "t_end", "g_start", "g_end"
    )
    return pairs.select("tfbs_key", "gene_id")


@query("in_regulatory_region", with_views("variants enhancers", """
select v.snp, e.enh_key, e.kind from variants v
join enhancers e on e.chr=v.chr and (abs(v.bp-e.e_start)<=50000 or abs(v.bp-e.e_end)<=50000)"""))
def _(fx):
    return ev.in_regulatory_region(fx.variants, fx.enhancers)


@query("regulatory_effect", with_views("variants genes enhancers associated_with", f"with {_REG} select snp, gene_key from reg"))
def _(fx):
    return ev.regulatory_effect(fx.variants, fx.enhancers, fx.associated_with)


@query("in_tad_with", with_views("variants genes tads", """
select v.snp, g.gene_key from variants v join genes g on g.gene_key=v.gene_key
union
select v.snp, t2.gene_key from variants v join tads t1 on t1.gene_key=v.gene_key join tads t2 on t2.tad_id=t1.tad_id"""))
def _(fx):
    return ev.in_tad_with(closest(fx), fx.tads)


_CAND = f"""
  cand as (
    select v.snp, g.gene_key from variants v join genes g on g.gene_key=v.gene_key
    union select v.snp, t2.gene_key from variants v join tads t1 on t1.gene_key=v.gene_key join tads t2 on t2.tad_id=t1.tad_id
    union select v.snp, g.gene_key from variants v join genes g on g.chr=v.chr and ({_NEAR_500K}))"""


@query("candidate_genes", with_views("variants genes tads", f"with {_CAND} select snp, gene_key from cand"))
def _(fx):
    return candidates(placed_once(fx))


@query("candidate_sets", with_views("variants genes tads", f"""with {_CAND}
select snp, array_to_string(list_sort(list(distinct upper(g.gene_id))), ',') as genes, count(distinct g.gene_id) as n_genes
from cand c join genes g on g.gene_key=c.gene_key group by snp"""))
def _(fx):
    fx = placed_once(fx)
    return ev.candidate_sets(candidates(fx, "gene_id"), fx.genes)


@query("relevant_gene_edges", with_views("variants genes enhancers associated_with evidence", f"""with {_REL}
select snp, gene_key, rule from rel"""))
def _(fx):
    return relevant(fx).distinct()


@query("noisy_or", with_views("variants genes enhancers associated_with evidence", f"""with {_SCORE}
select snp, gene_key, round(score,6) as score from score"""))
def _(fx):
    return ev.noisy_or(relevant(fx)).select("snp", "gene_key", F.round("score", 6).alias("score"))


@query("codes_for", """
select distinct l.l_partkey as gene_key, cast(o.o_custkey as varchar) as protein
from lineitem l join orders o on o.o_orderkey=l.l_orderkey""")
def _(fx):
    transcribed = fx.lineitem.select(F.col("l_partkey").alias("gene_key"), F.col("l_orderkey").alias("transcript"))
    translated = fx.orders.select(
        F.col("o_orderkey").alias("transcript"), F.col("o_custkey").cast("string").alias("protein")
    )
    return ev.codes_for(transcribed, translated)


@query("coexpressed_relevant", with_views("variants genes evidence", """
select distinct e.snp, g.gene_key from evidence e join genes g on g.gene_key=e.gene_key+22 or g.gene_key=e.gene_key-22"""))
def _(fx):
    links = fx.genes.select(
        F.col("gene_key"), F.explode(F.array(F.col("gene_key") - 22, F.col("gene_key") + 22)).alias("with_key")
    )
    return ev.coexpressed_relevant(fx.evidence, links)


_TF_SNP = """
  tf_snp as (select snp, 'tf'||cast(gene_key//4 as varchar) as tf, beta as score,
      case when beta<0 then 'loss' else 'gain' end as effect from variants where beta<>0
      union all select snp, 'tf'||cast((gene_key+7)//4 as varchar), se,
      'gain' from variants),
  regulates as (select distinct 'tf'||cast(gene_key//4 as varchar) as tf, gene_key from genes)"""


def tf_snp(fx: Fixtures) -> DataFrame:
    name = lambda shift: F.concat(F.lit("tf"), F.floor((F.col("gene_key") + shift) / 4).cast("string"))
    kind = F.when(F.col("beta") < 0, "loss").otherwise("gain")
    own = F.struct(name(0).alias("tf"), F.col("beta").alias("score"), kind.alias("effect"))
    other = F.struct(name(7).alias("tf"), F.col("se").alias("score"), F.lit("gain").alias("effect"))
    both = F.when(F.col("beta") != 0, F.array(own, other)).otherwise(F.array(other))  # one pass over the variants
    return fx.variants.select("snp", F.inline(both)).select("snp", "tf", "score", "effect")


@query("rank_tfs", with_views("variants genes", f"""with {_TF_SNP},
  hits as (select distinct t.snp, r.gene_key, t.tf, t.score from tf_snp t join regulates r on r.tf=t.tf
           where t.effect in ('loss','gain'))
select snp, gene_key, tf, abs(score) as abs_score,
  cast(row_number() over (partition by snp, gene_key order by abs(score) desc, tf, score) as int) as tf_rank from hits"""))
def _(fx):
    tf = F.concat(F.lit("tf"), F.floor(F.col("gene_key") / 4).cast("string"))
    return ev.rank_tfs(tf_snp(fx), fx.genes.select(tf.alias("tf"), "gene_key").distinct())


@query("tfbs_chain", with_views("tfbs enhancers", """
select distinct t.tfbs_key+1 as tf_gene, t.tfbs_key, e.enh_key from tfbs t
join enhancers e on e.chr=t.chr and e.e_start-4000<t.t_start and t.t_end<e.e_end+40000"""))
def _(fx):
    binds = fx.tfbs.select("tfbs_key", (F.col("tfbs_key") + 1).alias("tf_gene"))
    wide = fx.enhancers.withColumn("e_start", F.col("e_start") - 4000).withColumn("e_end", F.col("e_end") + 40000)
    return ev.tfbs_chain(fx.tfbs, binds, wide)


@query("annot_overlap", with_views("variants peaks", """
select v.snp, coalesce(array_to_string(list_sort(list(distinct p.cell_type) filter (where p.cell_type is not null)), ','), '') as cell_types,
  count(distinct p.cell_type) as n_annot
from variants v left join peaks p on p.chr=v.chr and p.start_bp<v.bp and v.bp<=p.end_bp group by v.snp"""))
def _(fx):
    sites = fx.variants.select("snp", "chr", "bp")
    hits = iv.annotate(sites, fx.peaks, "bp", "start_bp", "end_bp", "cell_type").groupBy("snp").agg(
        F.array_join(F.array_sort(F.collect_set("cell_type")), ",").alias("cell_types"),
        F.count_distinct("cell_type").alias("n_annot"),
    )
    return sites.join(hits, "snp", "left").select(
        "snp", F.coalesce("cell_types", F.lit("")).alias("cell_types"),
        F.coalesce("n_annot", F.lit(0)).cast("long").alias("n_annot"),
    )


@query("merged_peaks", with_views("peaks", """
with o as (select *, max(end_bp) over (partition by chr, cell_type order by start_bp, end_bp
             rows between unbounded preceding and 1 preceding) as reach from peaks),
  i as (select *, sum(case when reach is null or reach<start_bp then 1 else 0 end) over (partition by chr, cell_type
             order by start_bp, end_bp rows unbounded preceding) as island from o)
select chr, cell_type, min(start_bp) as start_bp, max(end_bp) as end_bp from i group by chr, cell_type, island"""))
def _(fx):
    return iv.merge_intervals(fx.peaks, ["chr", "cell_type"], "start_bp", "end_bp")


@query("locus_leads", with_views("variants", """
select chr, locus, snp, bp, mlog10p from (select *, cast(floor(bp/1000000) as bigint) as locus,
  row_number() over (partition by chr, cast(floor(bp/1000000) as bigint) order by p, snp) as rn from variants) t where rn=1"""))
def _(fx):
    return ev.locus_leads(fx.variants).select("chr", "locus", "snp", "bp", "mlog10p")


@query("region_windows", with_views("variants", """
with lead as (select * from (select *, row_number() over (partition by chr, cast(floor(bp/1000000) as bigint) order by p, snp) as rn
      from variants where p<5e-8) t where rn=1),
  numbered as (select *, row_number() over (order by chr, bp, snp) as k from lead)
select 'chr'||cast(l.chr as varchar)||':'||cast(l.bp as varchar) as region_id, cast((l.k-1)//5 as bigint) as batch_id, count(*) as n_variants,
  min(s.bp) as first_bp, max(s.bp) as last_bp
from numbered l join variants s on s.chr=l.chr and s.bp between l.bp-2000000 and l.bp+2000000
group by 1,2 having count(*)>=2"""))
def _(fx):
    from locusloom.operators.finemap import region_batches

    sig = fx.variants.filter(F.col("p") < 5e-8)
    leads = ev.locus_leads(sig).select(
        "snp", "chr", F.col("bp").alias("center"),
        F.concat(F.lit("chr"), F.col("chr").cast("string"), F.lit(":"), F.col("bp").cast("string")).alias("region_id"),
    )
    batches = region_batches(leads, 5)
    members = iv.region_members(leads.select("region_id", "chr", "center"), fx.variants.select("snp", "chr", "bp"), 2000)
    stats = members.groupBy("region_id").agg(
        F.count("*").alias("n_variants"), F.min("bp").alias("first_bp"), F.max("bp").alias("last_bp")
    )
    return stats.join(batches.select("region_id", "batch_id"), "region_id").select(
        "region_id", "batch_id", "n_variants", "first_bp", "last_bp"
    )


@query("proof_graph", with_views("variants genes enhancers associated_with evidence", """
with link as (select v.snp, e.enh_key, e.kind, a.gene_key from variants v
    join enhancers e on e.chr=v.chr and (abs(v.bp-e.e_start)<=50000 or abs(v.bp-e.e_end)<=50000)
    join associated_with a on a.enh_key=e.enh_key)
select snp, cast(gene_key as varchar) as gene, 'regulatory_effect' as pred, 'snp' as src_type, snp as src, 'gene' as dst_type, cast(gene_key as varchar) as dst from link
union select snp, cast(gene_key as varchar), 'in_regulatory_region', 'snp', snp, kind, cast(enh_key as varchar) from link
union select snp, cast(gene_key as varchar), 'associated_with', kind, cast(enh_key as varchar), 'gene', cast(gene_key as varchar) from link
union select snp, cast(gene_key as varchar), pred, 'snp', snp, 'gene', cast(gene_key as varchar) from evidence"""))
def _(fx):
    fx = _links_once(fx)
    return pf.proof_edges(pf.proofs(fx.variants, fx.enhancers, fx.associated_with, fx.evidence))


@query("proof_nodes", with_views("variants genes enhancers associated_with evidence", """
with link as (select v.snp, e.enh_key, e.kind, a.gene_key from variants v
    join enhancers e on e.chr=v.chr and (abs(v.bp-e.e_start)<=50000 or abs(v.bp-e.e_end)<=50000)
    join associated_with a on a.enh_key=e.enh_key)
select snp, cast(gene_key as varchar) as gene, 'snp' as type, snp as id from link
union select snp, cast(gene_key as varchar), 'gene', cast(gene_key as varchar) from link
union select snp, cast(gene_key as varchar), kind, cast(enh_key as varchar) from link
union select snp, cast(gene_key as varchar), 'snp', snp from evidence
union select snp, cast(gene_key as varchar), 'gene', cast(gene_key as varchar) from evidence"""))
def _(fx):
    fx = _links_once(fx)
    return pf.proof_nodes(pf.proof_edges(pf.proofs(fx.variants, fx.enhancers, fx.associated_with, fx.evidence)))


_SAMPLES = 20
_DRAW = "cast('0x'||substr(md5('42|'||cast(s.i as varchar)||'|{r}|'||cast(gene_key as varchar)||'|'||snp),1,8) as bigint)/4294967296.0::double"
_FIRST = " ".join(
    f"when max(case when rule='{r}' then 1 else 0 end)=1 and {_DRAW.format(r=r)}<{w} then '{r}'"
    for r, w in ev.RULE_WEIGHTS.items()
)


@query("sampled_proofs", with_views("variants genes enhancers associated_with evidence", f"""with {_REL},
  drawn as (select snp, gene_key, s.i, case {_FIRST} end as rule from rel, range(1,{_SAMPLES + 1}) s(i) group by snp, gene_key, s.i)
select snp, cast(gene_key as varchar) as gene, rule, count(*)/{_SAMPLES}::double as prob from drawn where rule is not null group by 1,2,3"""))
def _(fx):
    return pf.sampled_proofs(relevant(_links_once(fx)), _SAMPLES)


@query("expected_first_proof", with_views("variants genes enhancers associated_with evidence", f"""with {_REL},
  f as (select snp, gene_key, max(case when rule='regulatory_effect' then 1 else 0 end) as r,
     max(case when rule='eqtl_association' then 1 else 0 end) as e, max(case when rule='activity_by_contact' then 1 else 0 end) as a
     from rel group by 1,2)
select snp, cast(gene_key as varchar) as gene, 'regulatory_effect' as rule, 0.34::double as prob from f where r=1
union all select snp, cast(gene_key as varchar), 'eqtl_association', round((case when r=1 then 0.66::double else 1 end)*0.0176,8) from f where e=1
union all select snp, cast(gene_key as varchar), 'activity_by_contact',
  round((case when r=1 then 0.66::double else 1 end)*(case when e=1 then 0.9824::double else 1 end)*0.021,8) from f where a=1"""))
def _(fx):
    return pf.expected_first(relevant(fx)).withColumn("prob", F.round("prob", 8))


@query("proof_graph_json", with_views("variants genes enhancers associated_with evidence", f"""with {_REL},
  drawn as (select snp, gene_key, s.i, case {_FIRST} end as rule from rel, range(1,{_SAMPLES + 1}) s(i) group by snp, gene_key, s.i),
  freq as (select snp, cast(gene_key as varchar) as gene, rule, count(*)/{_SAMPLES}::double as prob from drawn where rule is not null group by 1,2,3)
select e.snp, cast(e.gene_key as varchar) as gene, f.rule,
  '{{"nodes":[{{"id":"'||f.gene||'","type":"gene"}},{{"id":"'||e.snp||'","type":"snp"}}],"edges":[{{"source":"'||e.snp||'","target":"'||f.gene||'","label":"'||e.pred||'"}}],"prob":{{"value":'||cast(f.prob as varchar)||'}}}}' as graph
from evidence e join freq f on f.snp=e.snp and f.gene=cast(e.gene_key as varchar) and f.rule=e.pred
union all
select f.snp, f.gene, f.rule, '{{"nodes":['||(select string_agg('{{"id":"'||id||'","type":"'||type||'"}}', ',' order by id, type)
    from (values (f.gene, 'gene'), (f.snp, 'snp'), (l.enh, l.kind)) n(id, type))||'],"edges":['||
  (select string_agg('{{"source":"'||source||'","target":"'||target||'","label":"'||label||'"}}', ',' order by source, target, label)
    from (values (f.snp, f.gene, 'regulatory_effect'), (f.snp, l.enh, 'in_regulatory_region'), (l.enh, f.gene, 'associated_with')) e(source, target, label))||
  '],"prob":{{"value":'||cast(f.prob as varchar)||'}}}}' as graph
from freq f join (select v.snp, cast(e.enh_key as varchar) as enh, e.kind, cast(a.gene_key as varchar) as gene from variants v
    join enhancers e on e.chr=v.chr and (abs(v.bp-e.e_start)<=50000 or abs(v.bp-e.e_end)<=50000)
    join associated_with a on a.enh_key=e.enh_key) l on l.snp=f.snp and l.gene=f.gene where f.rule='regulatory_effect'"""))
def _(fx):
    fx = _links_once(fx)
    rows = pf.proofs(fx.variants, fx.enhancers, fx.associated_with, fx.evidence)
    graphs = pf.proof_graphs(rows, pf.sampled_proofs(relevant(fx), _SAMPLES))
    return graphs.select("snp", "gene", "rule", "graph")
