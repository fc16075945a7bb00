"""Queries on ontologies, graphs, learned weights, curves and task history."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusloom.functions import columns as C
from locusloom.operators import evaluate as ev
from locusloom.operators import graph as gr
from locusloom.operators import history as hi
from locusloom.operators import learning as le
from locusloom.operators import ontology as on
from locusloom.plans.fixtures import with_views
from locusloom.plans.registry import query
from locusloom.plans.variant_gene import candidates, placed_once, relevant
from locusloom.operators.evidence import RULE_WEIGHTS, rule_flags

RULES = list(RULE_WEIGHTS)


def _tree(fx):
    """Child -> parent edges over parts, parent key = floor(key / 3)."""
    k = F.col("p_partkey")
    return fx.part.filter("p_partkey > 0").select(k.alias("child"), F.floor(k / 3).cast("long").alias("parent"))


_TREE = """
  up(node, ancestor, depth) as (select p_partkey, p_partkey, 0 from part
    union all select node, ancestor//3, depth+1 from up where ancestor>0)"""


@query("ontology_closure", f"with recursive {_TREE} select node, ancestor, depth from up")
def _(fx):
    return on.ancestors(_tree(fx))


@query("ontology_members", f"""with recursive {_TREE}
select l_suppkey as gene, ancestor as term, min(depth) as depth from (select distinct l_suppkey, l_partkey from lineitem) b join up on up.node=b.l_partkey group by 1,2""")
def _(fx):
    base = fx.lineitem.select(F.col("l_suppkey").alias("gene"), F.col("l_partkey").alias("term"))
    return on.term_members(base, on.ancestors(_tree(fx)))


@query("tissue_mapping", f"""with recursive {_TREE},
 t as (select c_name as tissue, case when c_custkey%7=0 then null when c_custkey%11=0 then c_custkey+100000000 else c_custkey end as source_id from customer),
 par as (select p_partkey as parent from part where p_size%10=7),
 ent as (select parent as id, parent, 0 as k, parent as o, parent as d from par
   union all select p_partkey, parent, 1, parent, p_partkey from par join part on p_partkey//3=parent and p_partkey>0),
 tgt as (select id, arg_max(parent, k*10000000000+o*100000+d%100000) as parent, min(k*10000000000+o*100000+d%100000) as ko from ent group by id),
 br as (select u.node, arg_min(tgt.id, tgt.ko) as b from up u join tgt on tgt.id=u.ancestor group by u.node)
select t.tissue, t.source_id, coalesce(g.parent, br.b) as parent_id,
  case when t.source_id is null then 'no_direct_uberon_found' when g.parent=t.source_id then 'direct' when g.parent is not null then 'descendant'
   when br.b is not null then 'broader_match_found' when t.source_id<100000000 and t.source_id in (select p_partkey from part) then 'no_cellxgene_match' else 'no_uberon_in_ontology' end as match_type
from t left join tgt g on g.id=t.source_id left join br on br.node=t.source_id""")
def _(fx):
    c = F.col("c_custkey")
    source = F.when(c % 7 == 0, None).when(c % 11 == 0, c + 100000000).otherwise(c)
    tissues = fx.customer.select(F.col("c_name").alias("tissue"), source.alias("source_id"))
    parents = fx.part.filter("p_size % 10 = 7").select(F.col("p_partkey").alias("parent"))
    kids = _tree(fx).withColumnRenamed("child", "descendant")
    listed = parents.join(kids, "parent", "left").withColumn("ord", F.col("parent"))
    return on.map_tissues(tissues, on.descendant_map(listed), on.ancestors(_tree(fx)))


def _go(fx):
    """Small gene sets: genes of one brand and type."""
    block = F.floor(F.col("gene_key") / 64).cast("string")
    return fx.genes.select("gene_key", F.concat_ws("/", "p_brand", "p_type", block).alias("go_id"))


def _hypotheses(fx):
    """One hypothesis per direct evidence edge."""
    names = fx.genes.join(_go(fx), "gene_key").select("gene_key", "gene_id", "go_id")
    return fx.evidence.join(names, "gene_key").select(
        F.concat("snp", F.lit("@"), "gene_id").alias("hypothesis_id"), "snp", F.col("gene_id").alias("causal_gene"), "pred",
        "go_id", F.upper("go_id").alias("go_name"), F.lit("EFO_1").alias("phenotype_id"), F.lit("obesity").alias("phenotype"))


_HYP = """
  h as (select e.snp||'@'||g.gene_id as hypothesis_id, e.snp, g.gene_id as causal_gene, e.pred, g.p_brand||'/'||g.p_type||'/'||cast(g.gene_key//64 as varchar) as go_id from evidence e join genes g on g.gene_key=e.gene_key),
  lab as (select snp, cast(chr as varchar)||':'||cast(bp as varchar)||'-'||cast(bp+1 as varchar)||'-'||a2||'>'||a1 as label from variants),
  mem as (select p_brand||'/'||p_type||'/'||cast(gene_key//64 as varchar) as go_id, gene_id as gene from genes)"""


def _members(fx):
    return fx.genes.join(_go(fx), "gene_key").select(
        "go_id", F.col("gene_id").alias("gene"), F.col("symbol").alias("gene_name"))


def _labels(fx):
    label = C.variant_label(F.col("chr"), F.col("bp"), F.col("bp") + 1, F.col("a2"), F.col("a1"))
    return fx.variants.select(F.col("snp").alias("old_id"), label.alias("new_id"), F.col("snp").alias("name"))


@query("hypothesis_graph", with_views("variants genes evidence", f"""with {_HYP}
select hypothesis_id, l.label as source, causal_gene as target, pred as label from h join lab l on l.snp=h.snp
union all select hypothesis_id, go_id, 'EFO_1', 'involved_in' from h
union all select hypothesis_id, m.gene, h.go_id, 'enriched_in' from h join mem m on m.go_id=h.go_id
union all select hypothesis_id, causal_gene, m.gene, 'coexpressed_with' from h join mem m on m.go_id=h.go_id"""))
def _(fx):
    h = _hypotheses(fx)
    causal = h.select("hypothesis_id", F.col("snp").alias("source"), F.col("causal_gene").alias("target"), F.col("pred").alias("label"))
    return gr.relabel(causal, _labels(fx)).unionByName(gr.extension_edges(h, _members(fx)))


@query("hypothesis_nodes", with_views("variants genes evidence", f"""with {_HYP}
select hypothesis_id, l.label as id, 'snp' as type, h.snp as name from h join lab l on l.snp=h.snp
union all select hypothesis_id, causal_gene, 'gene', causal_gene from h
union all select hypothesis_id, go_id, 'go', upper(go_id) from h union all select hypothesis_id, 'EFO_1', 'phenotype', 'obesity' from h
union all select hypothesis_id, m.gene, 'gene', g.symbol from h join mem m on m.go_id=h.go_id join genes g on g.gene_id=m.gene"""))
def _(fx):
    h = _hypotheses(fx)
    base = h.select("hypothesis_id", F.col("snp").alias("id"), F.lit("snp").alias("type")).union(
        h.select("hypothesis_id", "causal_gene", F.lit("gene")))
    return gr.relabel_nodes(base, _labels(fx)).unionByName(gr.extension_nodes(h, _members(fx)))


@query("truth_membership", with_views("variants genes tads", """
with near as (select v.snp, g.gene_key from variants v join genes g on g.chr=v.chr and (abs(v.bp-g.g_start)<=500000 or abs(v.bp-g.g_end)<=500000)
   union select v.snp, g.gene_key from variants v join genes g on g.gene_key=v.gene_key
   union select v.snp, t2.gene_key from variants v join tads t1 on t1.gene_key=v.gene_key join tads t2 on t2.tad_id=t1.tad_id),
 n as (select snp, count(*) as c from near group by 1)
select v.snp, cast(v.gene_key+44*(v.bp%6) as varchar) as gene, case when x.snp is null then 0 else 1 end as pred, coalesce(n.c,0) as num_pred
from variants v left join near x on x.snp=v.snp and x.gene_key=v.gene_key+44*(v.bp%6) left join n on n.snp=v.snp"""))
def _(fx):
    fx = placed_once(fx)
    gold = fx.variants.select(
        F.concat(F.lit(" "), F.upper("snp")).alias("snp"), (F.col("gene_key") + 44 * (F.col("bp") % 6)).cast("string").alias("gene"))
    return ev.truth_membership(gold, candidates(fx).select("snp", F.col("gene_key").cast("string").alias("gene")))


def _scored(fx):
    return fx.labels.join(fx.documents.select("doc_id", "n_chars"), "doc_id").select(
        (F.col("doc_id") % 5).cast("int").alias("fold"), (F.col("n_chars") % 1000 / F.lit(1000.0)).alias("score"), (F.col("quality") == 1).alias("label"))


_CURVE = """
  s as (select cast(l.doc_id%5 as int) as fold, (n_chars%1000)/1000.0::double as score, quality=1 as label from labels l join documents d on d.doc_id=l.doc_id),
  g as (select fold, score, count_if(label) as dtp, count_if(not label) as dfp from s group by 1,2),
  c as (select *, sum(dtp) over w as tp, sum(dfp) over w as fp, sum(dtp) over (partition by fold) as pos, sum(dfp) over (partition by fold) as neg
     from g window w as (partition by fold order by score desc rows unbounded preceding)),
  pt as (select fold, score, fp/neg::double as fpr, tp/pos::double as tpr, tp/(tp+fp)::double as prec from c),
  z as (select *, lag(fpr,1,0.0) over o as x0, lag(tpr,1,0.0) over o as y0, lag(tpr) over o as r0, lag(prec) over o as p0 from pt window o as (partition by fold order by score desc)),
  a as (select fold, sum((fpr-x0)*(tpr+y0)/2) as roc, sum((tpr-r0)*(prec+p0)/2) as pr from z group by fold)"""


@query("roc_pr_points", f"with {_CURVE} select fold, round(score,3) as score, round(fpr,6) as fpr, round(tpr,6) as tpr, round(prec,6) as precision from pt")
def _(fx):
    pts = ev.curve_points(_scored(fx), ["fold"], "score", "label")
    rows = ev.roc_pr_points(pts, ["fold", "score"])
    return rows.select("fold", *[F.round(c, n).alias(c) for c, n in (("score", 3), ("fpr", 6), ("tpr", 6), ("precision", 6))])


@query("roc_pr_auc", f"with {_CURVE} select fold, round(roc,6) as auc_roc, round(pr,6) as auc_pr from a")
def _(fx):
    out = ev.areas(ev.curve_points(_scored(fx), ["fold"], "score", "label"), ["fold"])
    return out.select("fold", F.round("auc_roc", 6).alias("auc_roc"), F.round("auc_pr", 6).alias("auc_pr"))


@query("fold_summary", f"with {_CURVE} select round(avg(roc),6) as mean_roc, round(stddev_samp(roc),6) as sd_roc, round(avg(pr),6) as mean_pr, round(stddev_samp(pr),6) as sd_pr from a")
def _(fx):
    out = ev.fold_summary(ev.areas(ev.curve_points(_scored(fx), ["fold"], "score", "label"), ["fold"]))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def _examples(fx):
    """Rule flags of evidence pairs with a label that leans on the regulatory rule."""
    flags = rule_flags(relevant(fx))
    mark = F.conv(F.substring(F.md5(F.concat("snp", F.lit("|"), F.col("gene_key").cast("string"))), 1, 4), 16, 10).cast("int")
    return flags.select(
        *RULES, (mark % 100 < F.col(RULES[0]) * 30 + F.col(RULES[1]) * 5 + 3).alias("label"),
        (F.col("gene_key") % 5).cast("int").alias("fold"), F.when(mark % 10 < 2, "test").otherwise("train").alias("split"))


_EX = """
  reg as (select distinct v.snp, a.gene_key from variants v join enhancers e on e.chr=v.chr and (abs(v.bp-e.e_start)<=50000 or abs(v.bp-e.e_end)<=50000)
          join associated_with a on a.enh_key=e.enh_key),
  rel as (select snp, gene_key, 'regulatory_effect' as rule from reg union select snp, gene_key, pred from evidence),
  fl as (select snp, gene_key, max(case when rule='regulatory_effect' then 1 else 0 end) as r, max(case when rule='eqtl_association' then 1 else 0 end) as e,
     max(case when rule='activity_by_contact' then 1 else 0 end) as a, cast('0x'||substr(md5(snp||'|'||cast(gene_key as varchar)),1,4) as int) as mark from rel group by 1,2),
  ex as (select *, mark%100<r*30+e*5+3 as label, cast(gene_key%5 as int) as fold, case when mark%10<2 then 'test' else 'train' end as split from fl)"""
_EX_VIEWS = "variants genes enhancers associated_with evidence"


@query("class_balance", with_views(_EX_VIEWS, f"with {_EX} select fold, split, label, count(*) as n from ex group by 1,2,3"))
def _(fx):
    return le.class_balance(_examples(fx))


@query("em_step", with_views(_EX_VIEWS, f"""with {_EX},
 q as (select *, 1-(1-0.25::double*r)*(1-0.25::double*e)*(1-0.25::double*a) as p from ex where split='train')
select fold, round(sum(case when label and r=1 then 0.25::double/p else 0 end)/sum(r),6) as regulatory_effect,
 round(sum(case when label and e=1 then 0.25::double/p else 0 end)/sum(e),6) as eqtl_association,
 round(sum(case when label and a=1 then 0.25::double/p else 0 end)/sum(a),6) as activity_by_contact from q group by fold"""))
def _(fx):
    patterns = le.firing_patterns(_examples(fx).filter("split = 'train'"), ["fold"], RULES)
    out = le.em_step(patterns, ["fold"], RULES, dict.fromkeys(RULES, le.START_WEIGHT))
    return out.select("fold", *[F.round(r, 6).alias(r) for r in RULES])


def _em_sql(steps: int) -> str:
    """The EM updates of every fold, written out."""
    miss = "(1-w.r*p.r)*(1-w.e*p.e)*(1-w.a*p.a)"
    part = lambda k: f"case when sum(n*p.{k})>0 then sum(case when label and p.{k}=1 then n*w.{k}/(1-{miss}) else 0 end)/sum(n*p.{k}) else any_value(w.{k}) end as {k}"
    ctes = ["pat as (select fold, r, e, a, label, count(*) as n from ex where split='train' group by all)",
            f"w0 as (select distinct fold, {le.START_WEIGHT}::double as r, {le.START_WEIGHT}::double as e, {le.START_WEIGHT}::double as a from pat)"]
    for i in range(steps):
        ctes.append(f"w{i + 1} as materialized (select p.fold, {part('r')}, {part('e')}, {part('a')} from pat p join w{i} w on w.fold=p.fold group by p.fold)")
    return ",\n".join(ctes)


@query("em_ten_steps", with_views(_EX_VIEWS, f"""with {_EX}, {_em_sql(10)}
select fold, round(r,6) as regulatory_effect, round(e,6) as eqtl_association, round(a,6) as activity_by_contact from w10"""))
def _(fx):
    patterns = le.firing_patterns(_examples(fx).filter("split = 'train'"), ["fold"], RULES)
    out = le.learn_weights(patterns, "fold", RULES, eps=0.0, restarts=1, max_steps=10)
    return out.select("fold", *[F.round(r, 6).alias(r) for r in RULES])


@query("em_weights")
def _(fx):
    # iterative; tests check the fixed point against closed forms
    patterns = le.firing_patterns(_examples(fx), ["fold", "split"], RULES)
    weights = le.learn_weights(patterns.filter("split = 'train'"), "fold", RULES)
    held = le.held_out_likelihood(patterns.filter("split = 'test'"), weights, "fold", RULES)
    out = weights.drop("log_likelihood").join(held, "fold")
    return out.select("fold", *[F.round(r, 4).alias(r) for r in RULES], F.round("log_likelihood", 3).alias("log_likelihood"))


@query("held_out_likelihood", with_views(_EX_VIEWS, f"""with {_EX},
 q as (select *, 1-(1-0.34::double*r)*(1-0.0176::double*e)*(1-0.021::double*a) as p from ex where split='test')
select fold, round(sum(case when label then ln(p) else ln(1-p) end),4) as log_likelihood from q group by fold"""))
def _(fx):
    patterns = le.firing_patterns(_examples(fx).filter("split = 'test'"), ["fold"], RULES)
    fixed = patterns.select("fold").distinct().select("fold", *[F.lit(w).alias(r) for r, w in RULE_WEIGHTS.items()])
    out = le.held_out_likelihood(patterns, fixed, "fold", RULES)
    return out.select("fold", F.round("log_likelihood", 4).alias("log_likelihood"))


def _history(fx):
    stored = fx.updates.filter("event_id % 2 = 0")
    return hi.merged_history(fx.updates.filter("event_id % 2 = 1 or event_id % 10 = 0"), stored)


@query("task_history", with_views("updates", """
select hypothesis_id, event_id, ts, task, state, progress, details from (select *, row_number() over (partition by hypothesis_id, task, ts order by event_id%2, event_id desc) as rn from updates) t where rn=1""").replace(
    "event_id, ts, task", "event_id, epoch_us(ts) as ts_us, task"))
def _(fx):
    rows = _history(fx)
    return rows.select("hypothesis_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "task", "state", "progress", "details")


@query("task_progress", with_views("updates", """
with d as (select hypothesis_id||'@'||strftime(ts, '%Y-%m-%d') as hypothesis_id, sum(case task when 'Getting candidate genes' then 10 when 'Predicting causal gene' then 20 when 'Getting relevant gene proof' then 20
   when 'Creating enrich data' then 20 else 0 end) as e, sum(case when task='Generating hypothesis' then 2 else 0 end) as h from updates where state='completed' group by 1)
select hypothesis_id, round(least(e/80.0::double*80+h/20.0::double*20,100.0::double),2) as progress from d"""))
def _(fx):
    # a run a day: over the whole month every hypothesis is complete
    day = F.concat_ws("@", "hypothesis_id", F.date_format("ts", "yyyy-MM-dd"))
    return hi.progress(fx.updates.withColumn("hypothesis_id", day))


@query("latest_state", with_views("updates", """
select hypothesis_id, task, state from (select *, row_number() over (partition by hypothesis_id order by ts desc, event_id desc) as rn from updates) t where rn=1"""))
def _(fx):
    return hi.latest(fx.updates).select("hypothesis_id", "task", "state")


@query("last_completed", with_views("updates", """
select hypothesis_id, event_id, task, cast(rn as int) as back from (select *, row_number() over (partition by hypothesis_id order by ts desc, event_id desc) as rn from updates where state='completed') t where rn<=5"""))
def _(fx):
    return hi.last_completed(fx.updates).select("hypothesis_id", "event_id", "task", "back")


@query("last_pending", with_views("updates", """
select hypothesis_id, task from (select *, row_number() over (partition by hypothesis_id order by ts desc, event_id desc) as rn from updates where state='started') t where rn=1"""))
def _(fx):
    return hi.last_pending(fx.updates).select("hypothesis_id", "task")


@query("update_status", with_views("updates", """
select event_id, case when state='completed' and task='Creating enrich data' then 'Enrichment_completed' when state='completed' and task='Generating hypothesis' then 'Hypothesis_completed'
  when state='failed' then 'failed' end as status,
  case when state='completed' and task='Creating enrich data' then 80.0::double when state='completed' and task='Generating hypothesis' then 100.0::double else progress end as progress from updates"""))
def _(fx):
    label = hi.status(F.col("task"), F.col("state"), F.col("progress"))
    return fx.updates.select("event_id", label.alias("status"), hi.status_progress(label, F.col("progress")).alias("progress"))
