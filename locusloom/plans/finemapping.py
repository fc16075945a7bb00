"""Queries on linkage, fine-mapping, independent signals and heritability."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusloom.functions.running import numbered, salted_join
from locusloom.functions.session import saved
from locusloom.operators import alignment
from locusloom.operators import finemap as fm
from locusloom.operators import heritability as h2
from locusloom.operators import ld
from locusloom.operators.signals import select_signals
from locusloom.plans.fixtures import with_views
from locusloom.plans.registry import query

WINDOW = 200
CATEGORIES = ("base", "third", "fourth")


def panel(fx):
    k = F.col("vec_id")
    weights = F.array(F.lit(1.0), F.when(k % 3 == 0, 1.0).otherwise(0.0), F.when(k % 4 == 1, 1.0).otherwise(0.0))
    return fx.embeddings.select(F.col("label").alias("region"), k.alias("id"), k.alias("pos"), F.col("embedding").alias("x"), weights.alias("annot"))


_PAIRS = f"""
  c as (select label as region, vec_id as id, list_transform(embedding::double[], lambda v: v-list_avg(embedding::double[])) as u from embeddings),
  pr as (select a.region, a.id as i, b.id as j, list_cosine_similarity(a.u, b.u) as r from c a join c b on b.region=a.region and b.id>a.id and b.id-a.id<={WINDOW})"""


@query("ld_matrix", f"with {_PAIRS} select region, i, j, round(r,6) as r from pr")
def _(fx):
    return ld.ld_pairs(panel(fx).drop("annot"), WINDOW).withColumn("r", F.round("r", 6))


_SCORES = _PAIRS + """,
  sym as (select i as id, j as other, r from pr union all select j, i, r from pr union all select id, id, 1.0::double from c),
  ls as (select id, k as category, sum((r*r-(1-r*r)/62.0::double)*case when k=0 then 1 when k=1 and other%3=0 then 1 when k=2 and other%4=1 then 1 else 0 end) as score
     from sym, (values (0),(1),(2)) t(k) group by 1,2)"""


@query("ld_scores", f"with {_SCORES} select id, category, round(score,5) as score from ls")
def _(fx):
    return ld.ld_scores(panel(fx), WINDOW, len(CATEGORIES)).withColumn("score", F.round("score", 5))


@query("ld_scores_printed", f"with {_SCORES} select id, category, round(score,5) as score from ls where id in (select c_custkey from customer where c_acctbal>0)")
def _(fx):
    listed = fx.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    out = ld.ld_scores(panel(fx), WINDOW, len(CATEGORIES)).join(listed, "id", "left_semi")
    return out.withColumn("score", F.round("score", 5))


def _stats(fx):
    locus = F.concat(F.lit("chr"), F.col("chr").cast("string"), F.lit(":"), F.floor(F.col("bp") / 1_000_000).cast("string"))
    return fx.variants.select(
        locus.alias("region_id"), F.col("snp").alias("id"), F.when(F.col("bp") % 2 == 0, F.col("snp")).alias("rs_id"), "chr", "bp", "a1", "a2",
        "frq", "beta", "se", (F.col("beta") / F.col("se")).alias("z"), "p", "n")


_ABF = """
  st as (select 'chr'||cast(chr as varchar)||':'||cast(cast(floor(bp/1000000) as bigint) as varchar) as region_id, snp as id, beta/se as z, * from variants),
  lb as (select *, 0.5*ln(se*se/(se*se+0.04::double))+0.5*z*z*0.04::double/(se*se+0.04::double) as lbf from st),
  mx as (select *, exp(lbf-max(lbf) over (partition by region_id)) as e from lb),
  pp as (select *, e/sum(e) over (partition by region_id) as pip, sum(e) over (partition by region_id) as tot from mx),
  cu as (select *, coalesce(sum(pip) over (partition by region_id order by round(lbf,9) desc, id rows between unbounded preceding and 1 preceding),0) as before from pp),
  cs as (select * from cu where before<0.95)"""


def _abf(fx):
    return fm.abf_pips(_stats(fx), ["region_id"])


def _abf_sets(fx):
    return saved(fm.credible_set(_abf(fx), ["region_id"], [F.round("lbf", 9).desc(), F.col("id")]).withColumn("cs", F.lit(1)), "sets")


@query("abf_pips", with_views("variants", f"with {_ABF} select region_id, id, round(pip,8) as pip from pp"))
def _(fx):
    stats = _stats(fx).select("region_id", "id", "z", "se")
    return fm.abf_pips(stats, ["region_id"]).select("region_id", "id", F.round("pip", 8).alias("pip"))


@query("abf_credible_sets", with_views("variants", f"with {_ABF} select region_id, id, round(pip,6) as pip from cs"))
def _(fx):
    return _abf_sets(fx).select("region_id", "id", F.round("pip", 6).alias("pip"))


@query("credible_set_stats", with_views("variants", f"with {_ABF} select region_id, count(*) as size, round(min(pip),6) as min_pip, round(max(pip),6) as max_pip from cs group by 1"))
def _(fx):
    out = fm.set_stats(_abf_sets(fx), ["region_id"])
    return out.select("region_id", "size", F.round("min_pip", 6).alias("min_pip"), F.round("max_pip", 6).alias("max_pip"))


@query("fallback_sets", with_views("variants", f"""with {_ABF},
 pr as (select region_id, id, round(pip,12) as pip from pp),
 hi as (select * from pr where pip>0.1), rk as (select *, row_number() over (partition by region_id order by pip desc, id) as rn from pr where region_id not in (select region_id from hi))
select region_id, id, 1 as cs from hi union all select region_id, id, 1 from rk where rn<=10"""))
def _(fx):
    # rounded, so that equal probabilities are equal in every engine
    return fm.fallback_set(saved(_abf(fx).select("region_id", "id", F.round("pip", 12).alias("pip")), "pips")).select("region_id", "id", "cs")


@query("padded_pips", with_views("variants", f"""with {_ABF}
select region_id, id, round(case when bp%3=0 then 0.01::double when bp%3=1 then pip else 1.0::double end,8) as pip from pp"""))
def _(fx):
    pips = _abf(fx).filter("bp % 3 <> 0").withColumn("pip", F.when(F.col("bp") % 3 == 2, F.col("pip") + 1.0).otherwise(F.col("pip")))
    out = fm.padded_pip(_stats(fx), pips, ["region_id", "id"])
    return out.select("region_id", "id", F.round("pip", 8).alias("pip"))


@query("locuszoom_pack", with_views("variants", f"""with {_ABF},
 n as (select *, cast((row_number() over (partition by region_id order by bp, cast(chr as varchar)||':'||cast(bp as varchar)||':'||a2||':'||a1)-1)//50 as bigint) as page from cs)
select region_id, page, max(page) over (partition by region_id) as last_page, round(beta,6) as beta, chr as chromosome, round(least(mlog10p,300),6) as log_pvalue, bp as position, a2 as ref_allele, a1 as alt_allele,
 round(frq,6) as ref_allele_freq, cast(chr as varchar)||':'||cast(bp as varchar)||':'||a2||':'||a1 as variant, round(pip,6) as posterior_prob, true as is_member, case when bp%2=0 then snp else '' end as rs_id from n"""))
def _(fx):
    packed = fm.locuszoom_pack(_abf_sets(fx), page_rows=50)
    back = packed.select("region_id", "page", "last_page", F.inline(F.arrays_zip(*[F.col("data")[f].alias(f) for f in fm.LOCUSZOOM_FIELDS])))
    return back.withColumns({c: F.round(c, 6) for c in ("beta", "log_pvalue", "ref_allele_freq", "posterior_prob")})


@query("lead_documents", with_views("variants", f"""with {_ABF},
 n as (select *, cast((row_number() over (partition by region_id order by bp, id)-1)//50 as bigint) as page from cs)
select region_id, page, count(*) as n_variants, string_agg(id, ',' order by bp, id) as variants from n group by 1,2"""))
def _(fx):
    from locusloom.operators.tables import paged

    pages = paged(_abf_sets(fx), ["region_id"], F.floor(F.col("bp") / 100_000), [F.col("bp"), F.col("id")], F.struct("id", "pip", "cs"), "credible_set", 50)
    return pages.select("region_id", "page", F.size("credible_set").cast("long").alias("n_variants"),
                        F.array_join(F.transform("credible_set", lambda r: r["id"]), ",").alias("variants"))


@query("run_summary", with_views("variants", f"""with {_ABF}, keep as (select * from cs where pip>0.1)
select count(*) as total_variants, count_if(pip>0.5)::bigint as high_confidence, 1 as max_credible_set, round(avg(abs(z)),6) as mean_abs_z, max(n) as max_n,
 (select count(distinct region_id) from keep) as regions_ok, (select count(distinct region_id) from st where region_id not in (select region_id from keep)) as regions_failed from keep"""))
def _(fx):
    out = fm.run_summary(_abf_sets(fx).filter("pip > 0.1"), _stats(fx))
    return out.select("total_variants", "high_confidence", F.col("max_credible_set"), F.round("mean_abs_z", 6).alias("mean_abs_z"), "max_n", "regions_ok", "regions_failed")


def members(fx):
    """Panel rows with z-scores built from two causal variants per region plus small noise."""
    rows = ld.standardised(panel(fx).drop("annot"))
    ends = rows.groupBy("region").agg(F.min_by("u", "id").alias("__c1"), F.max_by("u", "id").alias("__c2"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    noise = (F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 4), 16, 10).cast("double") / 65536.0 - 0.5)
    z = 11 * dot(F.col("u"), F.col("__c1")) + 9 * dot(F.col("u"), F.col("__c2")) + noise
    return salted_join(rows, ends, ["region"]).select(
        F.col("region").alias("region_id"), "id", z.alias("z"), F.lit(5000).cast("long").alias("n"), F.lit(0.3).alias("frq"), "u", "pos")


def _single_sql() -> str:
    """One effect per region: three grids of prior variances, each between the neighbours of the best before."""
    lbf = "0.5*ln(s2/(v+s2))+0.5*bhat*bhat/s2*v/(v+s2)"
    ctes = ["""tz as (select region, id, sqrt(4999/(z*z+4998))*z/sqrt(4999.0::double) as bhat, 1/4999.0::double as s2, count(*) over (partition by region) as m from z)""",
            "g0 as (select distinct region, -14.0::double as lo, 4.0::double as hi from tz)"]
    for i in range(3):
        ctes += [f"p{i} as (select region, k, lo+(hi-lo)*k/12 as x from g{i}, range(13) t(k))",
                 f"""l{i} as (select p.region, p.k, p.x, any_value(m) as m, max({lbf.replace('v', 'exp(x)')}) as top from tz join p{i} p using (region) group by 1,2,3)""",
                 f"""e{i} as (select l.region, l.k, l.x, any_value(l.m) as m, any_value(top)+ln(sum(exp({lbf.replace('v', 'exp(l.x)')}-top))) as ev from tz join l{i} l using (region) group by 1,2,3)""",
                 f"b{i} as (select region, arg_max(k, ev) as k, max(ev) as ev, any_value(m) as m from e{i} group by 1)",
                 f"""g{i + 1} as (select b.region, min(x) filter (where p.k=greatest(b.k-1,0)) as lo, max(x) filter (where p.k=least(b.k+1,12)) as hi, any_value(x) filter (where p.k=b.k) as x, any_value(b.ev) as ev, any_value(b.m) as m from b{i} b join p{i} p using (region) group by 1)"""]
    return ",\n".join(ctes) + f""", r as (select tz.*, exp({lbf.replace('v', 'exp(x)')}-ev) as pip, ev>ln(g3.m) as live from tz join g3 using (region))"""


@query("susie_single_effect", f"""with {_SCORES},
 ce as (select region, arg_min(u, id) as c1, arg_max(u, id) as c2 from c group by region),
 z as (select region, id, 11*list_cosine_similarity(u, c1)+9*list_cosine_similarity(u, c2)+cast('0x'||substr(md5(cast(id as varchar)),1,4) as int)/65536.0::double-0.5::double as z from c join ce using(region)),
 {_single_sql()}
select region as region_id, id, round(case when live then pip else 0 end,5) as pip from r""")
def _(fx):
    out = fm.susie_finemap(members(fx), effects=1, key_type="int", id_type="bigint")
    return out.select("region_id", "id", F.round("pip", 5).alias("pip"))


def _unturned(fx):
    """Three quarters of the statistics, every fifth with its alleles, and so its effect, the other way round."""
    turned = F.col("id") % 5 == 0
    chr_, bp = F.col("region_id").alias("chr"), F.col("id").alias("bp")
    a1, a2 = F.when(turned, "C").otherwise("A").alias("a1"), F.when(turned, "A").otherwise("C").alias("a2")
    z = F.when(turned, -F.col("z")).otherwise(F.col("z")).alias("z")
    return members(fx).filter("id % 4 <> 3").select("region_id", chr_, bp, a1, a2, z, "n")


@query("susie_matrix_effect", f"""with {_SCORES},
 ce as (select region, arg_min(u, id) as c1, arg_max(u, id) as c2 from c group by region),
 z as (select region, id, 11*list_cosine_similarity(u, c1)+9*list_cosine_similarity(u, c2)+cast('0x'||substr(md5(cast(id as varchar)),1,4) as int)/65536.0::double-0.5::double as z from c join ce using(region) where id % 4 <> 3),
 {_single_sql()}
select region as region_id, region||':'||id||':C:A' as id, round(case when live then pip else 0 end,5) as pip from r where m >= 2""")
def _(fx):
    # the panel's matrix cut to the rows and columns that have statistics, turned with them, lifted where it is not semidefinite
    rows = panel(fx).drop("annot")
    stand = ld.standardised(rows).select(F.col("region").alias("region_id"), F.col("region").alias("chr"), F.col("id").alias("bp"), F.lit("A").alias("a1"), F.lit("C").alias("a2"))
    placed = alignment.align_to_panel(_unturned(fx), stand, ["z", "n"])
    at = numbered(ld.standardised(rows).select(F.col("region").alias("region_id"), "id"), ["region_id"], F.floor(F.col("id") / 1000), [F.col("id")], "k")
    at = at.select("region_id", "id", (F.col("k") - 1).alias("k"))
    side = lambda c: at.select("region_id", F.col("id").alias(c), F.col("k").alias(f"{c}_k"))
    pairs = ld.ld_pairs(rows, WINDOW).withColumnRenamed("region", "region_id").join(side("i"), ["region_id", "i"]).join(side("j"), ["region_id", "j"])
    cut = alignment.aligned_matrix(pairs.select("region_id", F.col("i_k").alias("i"), F.col("j_k").alias("j"), "r"), placed)
    out = fm.susie_finemap_matrix(placed, cut, effects=1, key_type="int", id_type="string")
    return out.select("region_id", "id", F.round("pip", 5).alias("pip"))


@query("susie_finemap")
def _(fx):
    # iterative; tests check simulated regions with known causal variants
    out = fm.susie_finemap(members(fx), effects=5, key_type="int", id_type="bigint")
    return out.select("region_id", "id", F.round("pip", 4).alias("pip"), "cs", "effects", "converged")


@query("susie_sets")
def _(fx):
    fitted = fm.susie_finemap(members(fx), effects=-1, key_type="int", id_type="bigint")
    return fm.final_sets(fitted).select("region_id", "id", F.round("pip", 4).alias("pip"), "cs", "effects")


@query("cojo_select")
def _(fx):
    out = select_signals(members(fx))
    return out.select("region_id", "id", F.round("z", 4).alias("z"), F.round("joint_z", 4).alias("joint_z"), F.round("joint_p", 10).alias("joint_p"), "step")


BLOCKS = 20


def _h2_sums(fx):
    scores = ld.ld_scores(panel(fx), WINDOW, len(CATEGORIES))
    base = scores.filter("category = 0").select("id", F.array("score").alias("scores"))
    cells = scores.filter("category > 0").select("id", F.concat(F.lit("cell"), F.col("category").cast("string")).alias("cell_type"), "score")
    stats = members(fx).select("id", "z", "n", F.lit(1).alias("chr"), "pos")
    blocks = h2.snp_blocks(stats, BLOCKS, width=1000)
    return h2.block_sums(h2.regression_rows(blocks, base, cells))


@query("h2_block_sums", f"""with {_SCORES},
 e as (select region, arg_min(u, id) as c1, arg_max(u, id) as c2 from c group by region),
 z as (select id, 11*list_cosine_similarity(u, c1)+9*list_cosine_similarity(u, c2)+cast('0x'||substr(md5(cast(id as varchar)),1,4) as int)/65536.0::double-0.5::double as z from c join e using(region)),
 b as (select *, z*z as chi2, cast((row_number() over (order by id)-1)*{BLOCKS}//count(*) over () as int) as block from z),
 j as (select b.*, l.score as base from b join ls l on l.id=b.id and l.category=0),
 m as (select greatest((avg(chi2)-1)/avg(base),0) as ratio from j),
 w as (select j.*, 1/(greatest(base,1)*power(1+ratio*greatest(base,1),2)) as w from j, m)
select 'cell'||cast(l.category as varchar) as cell_type, w.block, round(sum(w*l.score*l.score),4) as cell_cell, round(sum(w*l.score*chi2),4) as cell_y, round(sum(w*base*chi2),4) as base_y, count(*) as rows
from w join ls l on l.id=w.id and l.category>0 group by 1,2""")
def _(fx):
    named = {"cell_cell": F.col("xx")[0], "cell_y": F.col("xy")[0], "base_y": F.col("xy")[1]}
    return _h2_sums(fx).select("cell_type", "block", *[F.round(c, 4).alias(name) for name, c in named.items()], "rows")


_SUMS = ("cc", "cb", "co", "cy", "bb", "bo", "b_y", "oo", "o_y")


def _det(first: tuple[str, str, str]) -> str:
    """Determinant of the normal equations with ``first`` as their first column."""
    x, y, z = first
    return f"({x}*(bb*oo-bo*bo)-cb*({y}*oo-bo*{z})+co*({y}*bo-bb*{z}))"


_CELL = f"{_det(('cy', 'b_y', 'o_y'))}/{_det(('cc', 'cb', 'co'))}/5000.0::double"


@query("h2_jackknife", f"""with {_SCORES},
 e as (select region, arg_min(u, id) as c1, arg_max(u, id) as c2 from c group by region),
 z as (select id, 11*list_cosine_similarity(u, c1)+9*list_cosine_similarity(u, c2)+cast('0x'||substr(md5(cast(id as varchar)),1,4) as int)/65536.0::double-0.5::double as z from c join e using(region)),
 b as (select *, z*z as chi2, cast((row_number() over (order by id)-1)*{BLOCKS}//count(*) over () as int) as block from z),
 j as (select b.*, l.score as base from b join ls l on l.id=b.id and l.category=0),
 m as (select greatest((avg(chi2)-1)/avg(base),0) as ratio from j),
 w as (select j.*, 1/(greatest(base,1)*power(1+ratio*greatest(base,1),2)) as w from j, m),
 s as (select 'cell'||cast(l.category as varchar) as name, w.block, sum(w*l.score*l.score) as cc, sum(w*l.score*base) as cb, sum(w*l.score) as co, sum(w*l.score*chi2) as cy,
   sum(w*base*base) as bb, sum(w*base) as bo, sum(w*base*chi2) as b_y, sum(w) as oo, sum(w*chi2) as o_y from w join ls l on l.id=w.id and l.category>0 group by 1,2),
 t as (select name, {", ".join(f"sum({k}) as {k}" for k in _SUMS)}, count(*) as k from s group by 1),
 whole as (select name, k, {_CELL} as est from t),
 d as (select s.name, {", ".join(f"t.{k}-s.{k} as {k}" for k in _SUMS)} from s join t using (name)),
 parts as (select d.name, k*est-(k-1)*{_CELL} as pseudo, k from d join whole using (name))
select name, round(avg(pseudo)*1e4,6) as coefficient_e4, round(stddev_samp(pseudo)/sqrt(any_value(k))*1e4,6) as std_error_e4 from parts group by name""")
def _(fx):
    out = h2.cell_type_coefficients(_h2_sums(fx))
    return out.select("name", F.round(F.col("coefficient") * 1e4, 6).alias("coefficient_e4"), F.round(F.col("std_error") * 1e4, 6).alias("std_error_e4"))


@query("h2_cell_type")
def _(fx):
    # small solves per cell type on block sums; the sums themselves are checked by h2_block_sums
    out = h2.cell_type_coefficients(_h2_sums(fx))
    return out.select("name", F.round("coefficient", 8).alias("coefficient"), F.round("std_error", 8).alias("std_error"), F.round("p_value", 6).alias("p_value"))


FIVE = ("1.0", "case when {0}%2=0 then 1.0 else 0.0 end", "case when {0}%5=1 then 1.0 else 0.0 end", "case when {0}%7<3 then 1.0 else 0.0 end",
        "case when {0}%11<4 then 1.0 else 0.0 end")
TWO = ("case when {0}%3=0 then 1.0 else 0.0 end", "case when {0}%4=1 then 1.0 else 0.0 end")
_X = ("x0", "x1", "x2", "x3", "x4", "x5", "x6")


def _eliminated(name: str, start: str) -> str:
    """CTEs that solve the normal equations in ``start(key, i, j, v)`` (j = 7: right side) by elimination; ``name`` holds i, v."""
    out, last = [], start
    for k in range(7):
        step = f"{name}{k}"
        out.append(f"""{step} as materialized (select a.key, a.i, a.j, case when a.i={k} then a.v/p.v else a.v-c.v*r.v/p.v end as v from {last} a
   join {last} p on p.key=a.key and p.i={k} and p.j={k} join {last} r on r.key=a.key and r.i={k} and r.j=a.j join {last} c on c.key=a.key and c.j={k} and c.i=a.i)""")
        last = step
    return ",\n ".join([*out, f"{name} as (select key, i, v from {last} where j=7)"])


def _equations(rows: str, keys: str) -> str:
    """Sums of all products of the regressors of ``rows`` in long form."""
    cells = [(i, j, f"sum(w*{_X[i]}*{_X[j] if j < 7 else 'chi2'})") for i in range(7) for j in range(8)]
    parts = [f"select {keys}, {i} as i, {j} as j, {v} as v from {rows} group by {keys}" for i, j, v in cells]
    return " union all ".join(parts)


@query("h2_five_baselines", f"""with {_PAIRS},
 sym as (select i as id, j as other, r from pr union all select j, i, r from pr union all select id, id, 1.0::double from c),
 sc as materialized (select id, {", ".join(f"sum((r*r-(1-r*r)/62.0::double)*({a.format('other')})::double) as {x}" for a, x in zip(FIVE, _X[1:6], strict=True))},
   {", ".join(f"sum((r*r-(1-r*r)/62.0::double)*({a.format('other')})::double) as t{k}" for k, a in enumerate(TWO, 1))} from sym group by 1),
 e as (select region, arg_min(u, id) as c1, arg_max(u, id) as c2 from c group by region),
 z as (select id, 11*list_cosine_similarity(u, c1)+9*list_cosine_similarity(u, c2)+cast('0x'||substr(md5(cast(id as varchar)),1,4) as int)/65536.0::double-0.5::double as z from c join e using(region)),
 b as (select id, z*z as chi2, cast((row_number() over (order by id)-1)*{BLOCKS}//count(*) over () as int) as block from z),
 j as (select *, greatest(x1+x2+x3+x4+x5,1) as l from b join sc using (id)),
 m as (select greatest((avg(chi2)-1)/avg(x1+x2+x3+x4+x5),0) as ratio from j),
 w0 as materialized (select t.k as cell, j.*, 1.0::double as x6, case t.k when 1 then t1 else t2 end as x0, 1/(l*power(1+ratio*l,2)) as w from j, m, (values (1),(2)) t(k)),
 q as materialized (select cell as key, i, j, v from ({_equations('w0', 'cell')})),
 {_eliminated('f', 'q')},
 w1 as materialized (select w0.* exclude (w), 1/(l*power(greatest({"+".join(f"{x}*(select v from f where key=cell and i={i})" for i, x in enumerate(_X))},1),2)) as w from w0),
 s as materialized ({_equations('w1', 'cell, block')}),
 t as materialized (select cell, i, j, sum(v) as v from s group by all),
 d as materialized (select cell*1000+999 as key, i, j, v from t union all select cell*1000+block, i, j, t.v-s.v from s join t using (cell, i, j)),
 {_eliminated('g', 'd')},
 h as (select key//1000 as cell, key%1000 as block, v/5000.0::double as est from g where i=0),
 ps as (select a.cell, {BLOCKS}*o.est-({BLOCKS}-1)*a.est as pseudo from h a join h o on o.cell=a.cell and o.block=999 where a.block<999),
 n as (select cell, avg(pseudo) as est, stddev_samp(pseudo)/sqrt({BLOCKS}) as se from ps group by 1),
 y as (select *, abs(est/se)/sqrt(2.0::double) as y from n)
select 'cell'||cast(cell as varchar) as name, round(est*1e4,4) as coefficient_e4, round(se*1e4,4) as std_error_e4,
  round(0.5-0.5*sign(est)*2/sqrt(pi())*exp(-y*y)*(select sum(y*exp(k*ln(4)+lgamma(k+1)+2*k*ln(y)-lgamma(2*k+2))) from range(0,200) r(k)),4) as p_value from y""")
def _(fx):
    k = F.col("vec_id")
    annot = F.array(*[F.expr(f"cast({a.format('vec_id')} as double)") for a in (*FIVE, *TWO)])
    rows = fx.embeddings.select(F.col("label").alias("region"), k.alias("id"), k.alias("pos"), F.col("embedding").alias("x"), annot.alias("annot"))
    scores = ld.ld_scores(rows, WINDOW, 7)
    base = scores.filter("category < 5").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("category", "score"))).alias("s"))
    cells = scores.filter("category >= 5").select("id", F.concat(F.lit("cell"), (F.col("category") - 4).cast("string")).alias("cell_type"), "score")
    stats = members(fx).select("id", "z", "n", F.lit(1).alias("chr"), "pos")
    blocks = h2.snp_blocks(stats, BLOCKS, width=1000)
    joined = h2.regression_rows(blocks, base.select("id", F.col("s.score").alias("scores")), cells)
    out = h2.cell_type_coefficients(h2.weighted_sums(joined, 5, rounds=1))
    return out.select("name", F.round(F.col("coefficient") * 1e4, 4).alias("coefficient_e4"),
                      F.round(F.col("std_error") * 1e4, 4).alias("std_error_e4"), F.round("p_value", 4).alias("p_value"))


@query("cell_type_completeness", with_views("peaks", """
with f as (select distinct cell_type, chr from peaks where not (cell_type='Brand#3' and chr in (5,9)) and cell_type<>'Brand#1')
select cell_type, count(*)=22 as is_complete, coalesce((select string_agg(cast(k as varchar), ',' order by k) from range(1,23) t(k) where k not in (select chr from f g where g.cell_type=f.cell_type)),'') as missing from f group by cell_type"""))
def _(fx):
    done = fx.peaks.select(F.when(F.col("cell_type") == "Brand#1", h2.MERGED_NAME).otherwise(F.col("cell_type")).alias("cell_type"), "chr")
    done = done.filter("not (cell_type = 'Brand#3' and chr in (5, 9))")
    return h2.completeness(done).withColumn("missing", F.array_join(F.transform("missing", lambda x: x.cast("string")), ","))
