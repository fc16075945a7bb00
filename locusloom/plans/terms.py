"""Queries on gene sets, expression, term retrieval, passages and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusloom.operators import coexpression as ce
from locusloom.operators import enrichment as en
from locusloom.operators import evaluate as ev
from locusloom.operators import retrieval as rt
from locusloom.plans.fixtures import with_views
from locusloom.plans.registry import query


def _sets(fx):
    """Lists by type and size class, terms by brand, all genes as background."""
    genes = fx.genes.select("gene_key", F.col("gene_id").alias("gene"), "p_brand", "p_type")
    sized = genes.join(fx.part.select(F.col("p_partkey").alias("gene_key"), "p_size"), "gene_key")
    lists = sized.select(F.concat_ws("/", "p_type", (F.col("p_size") % 3).cast("string")).alias("list_id"), "gene")
    number = F.substring_index("p_brand", "#", -1)
    library = genes.select(F.concat("p_brand", F.lit(" (GO:"), F.lpad(number, 7, "0"), F.lit(")")).alias("term"), "gene")
    return lists, library, genes.select("gene")


_SETS = """
  lists as (select g.p_type||'/'||cast(p.p_size%3 as varchar) as list_id, g.gene_id as gene from genes g join part p on p.p_partkey=g.gene_key),
  lib as (select p_brand||' (GO:'||lpad(split_part(p_brand,'#',2),7,'0')||')' as term, gene_id as gene from genes)"""
_ORA = _SETS + """,
  c as (select l.list_id, b.term, count(*) as x from lists l join lib b on b.gene=l.gene group by 1,2),
  k as (select list_id, count(*) as k from lists group by 1), m as (select term, count(*) as m from lib group by 1),
  s as (select c.*, k.k, m.m, (select count(*) from genes) as n from c join k using(list_id) join m using(term)),
  t as (select s.*, i from s, unnest(range(x, least(k,m)+1)) as u(i)),
  pv as (select list_id, term, x, k, m, n, least(1.0, sum(case when k-i<=n-m then exp(lgamma(m+1.0)-lgamma(i+1.0)-lgamma(m-i+1.0)
     +lgamma(n-m+1.0)-lgamma(k-i+1.0)-lgamma(n-m-k+i+1.0)-lgamma(n+1.0)+lgamma(k+1.0)+lgamma(n-k+1.0)) else 0 end)) as p from t group by all),
  r as (select *, rank() over (partition by list_id order by p) as r0, count(*) over (partition by list_id) as mm,
     count(*) over (partition by list_id order by p range between unbounded preceding and current row) as rk from pv),
  q as (select *, least(1.0, min(p*mm/rk) over (partition by list_id order by p desc range between unbounded preceding and current row)) as adjusted_p from r)"""


@query("over_representation", with_views("genes", f"""with {_ORA}
select list_id, term, x as overlap, k as list_size, m as term_size, round(p,6) as p, round(adjusted_p,6) as adjusted_p from q"""))
def _(fx):
    rows = en.over_representation(*_sets(fx))
    return rows.select("list_id", "term", "overlap", "list_size", "term_size", F.round("p", 6).alias("p"), F.round("adjusted_p", 6).alias("adjusted_p"))


@query("enriched_terms", with_views("genes", f"""with {_ORA}
select list_id, 'GO:'||lpad(split_part(split_part(term,' (',1),'#',2),7,'0') as id, split_part(term,'(',1) as name,
  case when cast(split_part(split_part(term,' (',1),'#',2) as int)%4=0 then 'NA' else 'about '||split_part(term,' (',1) end as "desc", round(adjusted_p,6) as adjusted_p
from q where adjusted_p<0.9"""))
def _(fx):
    rows = en.significant_terms(en.over_representation(*_sets(fx)), 0.9)
    number = F.substring_index("p_brand", "#", -1)
    descriptions = fx.part.filter(number.cast("int") % 4 != 0).select(
        F.concat(F.lit("GO:"), F.lpad(number, 7, "0")).alias("id"), F.concat(F.lit("about "), "p_brand").alias("desc")).distinct()
    out = en.attach_description(en.with_term_parts(rows), descriptions)
    return out.select("list_id", "id", "name", "desc", F.round("adjusted_p", 6).alias("adjusted_p"))


@query("overlap_genes", with_views("genes", f"""with {_SETS}
select l.list_id, b.term, cast(0 as bigint) as page, string_agg(l.gene, ';' order by l.gene) as genes
from lists l join lib b on b.gene=l.gene group by 1,2"""))
def _(fx):
    lists, library, _ = _sets(fx)
    return en.overlap_genes(lists, library)


@query("bh_fdr", with_views("variants genes", """
with v as (select v.snp, g.p_brand, case when v.bp%29=0 then null else power(10.0::double, -v.mlog10p/4) end as p from variants v join genes g on g.gene_key=v.gene_key),
 f as (select *, coalesce(p,1) as q from v),
 r as (select *, count(*) over (partition by p_brand) as m, count(*) over (partition by p_brand order by q range between unbounded preceding and current row) as rk from f)
select snp, p_brand, round(least(1.0, min(q*m/rk) over (partition by p_brand order by q desc range between unbounded preceding and current row)),6) as fdr from r"""))
def _(fx):
    p = F.when(F.col("bp") % 29 != 0, F.pow(F.lit(10.0), -F.col("mlog10p") / 4))
    rows = fx.variants.join(fx.genes.select("gene_key", "p_brand"), "gene_key").select("snp", "p_brand", p.alias("p"))
    return en.benjamini_hochberg(rows, ["p_brand"], "p", "fdr").select("snp", "p_brand", F.round("fdr", 6).alias("fdr"))


@query("ranked_results", with_views("variants genes", """
select snp, mlog10p, rank from (select v.snp, round(v.mlog10p,6) as mlog10p, cast(row_number() over (order by v.mlog10p desc, v.snp) as int) as rank from variants v) t where rank<=15"""))
def _(fx):
    # the report's head 15; ranks are numbered after the top rows are found
    from pyspark.sql import Window

    head = fx.variants.select("snp", F.round("mlog10p", 6).alias("mlog10p")).orderBy(F.col("mlog10p").desc(), "snp").limit(15)
    return head.withColumn("rank", F.row_number().over(Window.orderBy(F.col("mlog10p").desc(), "snp")))


@query("top_tissues", """
with t as (select n_name||' ('||c_mktsegment||')' as name, avg(c_acctbal) as coef, (count(*)%100)/10000.0::double as p, count(*) as n from customer join nation on n_nationkey=c_nationkey group by 1)
select name, round(coef,4) as coef from t where p<0.01 order by coef desc, name limit 10""")
def _(fx):
    rows = fx.customer.join(fx.nation, fx.customer.c_nationkey == fx.nation.n_nationkey).groupBy(
        F.concat("n_name", F.lit(" ("), "c_mktsegment", F.lit(")")).alias("name")).agg(
        F.avg("c_acctbal").alias("coef"), ((F.count("*") % 100) / F.lit(10000.0)).alias("p"))
    top = rows.filter(F.col("p") < 0.01).orderBy(F.col("coef").desc(), "name").limit(10)
    return top.select("name", F.round("coef", 4).alias("coef"))


def _expression(fx):
    value = F.sum("l_quantity").alias("value")
    matrix = (
        fx.lineitem.join(fx.orders.select("o_orderkey", "o_custkey"), fx.lineitem.l_orderkey == fx.orders.o_orderkey)
        .join(fx.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("o_custkey").alias("cell"), F.col("p_brand").alias("gene")).agg(value))
    obs = fx.customer.join(fx.nation, fx.customer.c_nationkey == fx.nation.n_nationkey).select(
        F.col("c_custkey").alias("cell"), F.col("n_name").alias("tissue"), F.col("c_mktsegment").alias("cell_type"))
    return matrix, obs


_EXPR = """
  e as (select o_custkey as cell, p_brand as gene, sum(l_quantity) as value from lineitem join orders on o_orderkey=l_orderkey
     join part on p_partkey=l_partkey group by 1,2),
  x as (select e.*, n_name as tissue, c_mktsegment as cell_type from e join customer on c_custkey=cell join nation on n_nationkey=c_nationkey)"""
_CORR = _EXPR + """,
  seed as (select tissue, cell, gene as seed, value as xv from x where value<>0),
  n as (select tissue, seed, count(*)::double as n, sum(xv) as sx, sum(xv*xv) as sxx from seed group by 1,2),
  p as (select s.tissue, s.seed, x.gene, sum(value) as sy, sum(value*value) as syy, sum(xv*value) as sxy
     from seed s join x on x.tissue=s.tissue and x.cell=s.cell and x.gene<>s.seed group by 1,2,3),
  corr as (select tissue, seed, gene, cast(n as bigint) as n, (n*sxy-sx*sy)/sqrt((n*sxx-sx*sx)*(n*syy-sy*sy)) as r
     from p join n using(tissue,seed) where n>=2 and n*syy-sy*sy>1e-9*n*syy and n*sxx-sx*sx>1e-9*n*sxx)"""


def _corr(fx):
    matrix, obs = _expression(fx)
    seeds = fx.part.select(F.col("p_brand").alias("seed"))
    return ce.correlations(ce.expression_slice(matrix, obs), seeds)


@query("coexpression", f"with {_CORR} select tissue, seed, gene, n, round(r,5) as r from corr")
def _(fx):
    return _corr(fx).withColumn("r", F.round("r", 5))


@query("coexpression_strongest", f"""with {_CORR}, rr as (select * replace (round(r,6) as r) from corr)
select tissue, seed, gene, r, cast(rank as int) as rank, 'positive' as side from (select *, row_number() over (partition by tissue, seed order by r desc, gene) as rank from rr) t where rank<=3
union all select tissue, seed, gene, r, cast(rank as int), 'negative' from (select *, row_number() over (partition by tissue, seed order by r, gene desc) as rank from rr) t where rank<=3""")
def _(fx):
    rounded = _corr(fx).withColumn("r", F.round("r", 6))
    return ce.strongest(rounded, 3).select("tissue", "seed", "gene", "r", "rank", "side")


# two-sided tail of Student's t as the finite sums that hold for whole degrees of freedom
_T_TAIL = """
  t as (select *, n-2 as df, abs(r) as s, sqrt(1-r*r) as c from corr where n>2),
  tail as (select tissue, seed, gene, r, case when df%2=0 then 1-s*coalesce((select sum(exp(lgamma(j+0.5)-lgamma(j+1)-0.5*ln(pi()))*pow(c,2*j)) from range(df//2) u(j)),0)
    else 1-2/pi()*(asin(s)+s*coalesce((select sum(exp(lgamma(j+1)-lgamma(j+1.5)+0.5*ln(pi()))/2*pow(c,2*j+1)) from range((df-1)//2) u(j)),0)) end as p from t)"""


@query("coexpression_significant", f"""with {_CORR}, {_T_TAIL}
select tissue, seed, gene, round(r,5) as r, round(p,6) as p from tail where p<0.05""")
def _(fx):
    rows = ce.significant_correlations(_corr(fx))
    return rows.select("tissue", "seed", "gene", F.round("r", 5).alias("r"), F.round("p", 6).alias("p"))


@query("expression_slice", f"""with {_EXPR}
select cell, gene, value, tissue from x where tissue='NATION_3' and cell_type='BUILDING'""")
def _(fx):
    matrix, obs = _expression(fx)
    return ce.expression_slice(matrix, obs, "NATION_3", "BUILDING").select("cell", "gene", "value", "tissue")


@query("expression_counts", f"""with {_EXPR}, c as (select tissue, count(distinct cell) as cells from x group by 1)
select tissue, gene, count_if(value<>0)::bigint as nonzero, any_value(cells) as cells, round(100.0::double*count_if(value<>0)/any_value(cells),4) as percent
from x join c using(tissue) group by 1,2""")
def _(fx):
    matrix, obs = _expression(fx)
    return ce.expression_counts(ce.expression_slice(matrix, obs)).withColumn("percent", F.round("percent", 4))


@query("first_n_cells", """
select cell, tissue, cell_type from (select c_custkey as cell, n_name as tissue, c_mktsegment as cell_type,
  row_number() over (partition by n_name order by c_custkey) as rn from customer join nation on n_nationkey=c_nationkey) t where rn<=5""")
def _(fx):
    return ce.first_cells(_expression(fx)[1], 5)


_REQ = """
  req as (select label, arg_min(embedding, vec_id) as query from embeddings group by label)"""


def _requests(fx):
    requests = fx.embeddings.groupBy(F.col("label").alias("request_id")).agg(F.min_by("embedding", "vec_id").alias("query"))
    return requests, fx.embeddings.select(F.col("label").alias("request_id"), F.col("vec_id").alias("term_id"), "embedding")


@query("term_topk", f"""with {_REQ},
 s as (select r.label as request_id, e.vec_id as term_id, list_cosine_similarity(r.query::double[], e.embedding::double[]) as score from req r join embeddings e on e.label=r.label)
select request_id, term_id, round(score,6) as score, cast(rank as int) as rank from (select *, row_number() over (partition by request_id order by score desc, term_id) as rank from s) t where rank<=10""")
def _(fx):
    return rt.nearest_terms(*_requests(fx), 10).withColumn("score", F.round("score", 6))


@query("term_topk_l2", f"""with {_REQ},
 s as (select r.label as request_id, e.vec_id as term_id, list_distance(r.query::double[], e.embedding::double[]) as score from req r join embeddings e on e.label=r.label)
select request_id, term_id, round(score,6) as score, cast(rank as int) as rank from (select *, row_number() over (partition by request_id order by score, term_id) as rank from s) t where rank<=10""")
def _(fx):
    return rt.nearest_terms(*_requests(fx), 10, "l2").withColumn("score", F.round("score", 6))


# whole texts, their sentences, and terms down to one character
_PAT = """pat as (select text as name from benchmark union select unnest(string_split(text, '. ')) from benchmark
  union select o_orderstatus from orders union select p_type from part union select role from conversations)"""


@query("contains_match", f"""with {_PAT}
select d.doc_id, p.name from documents d join pat p on p.name<>'' and contains(lower(d.text), lower(p.name))""")
def _(fx):
    return rt.contains_pairs(fx.documents, _patterns(fx), "doc_id", "text", "name", "name")


def _patterns(fx):
    sentences = fx.benchmark.select(F.explode(F.split("text", r"\. ")).alias("name"))
    terms = fx.orders.select("o_orderstatus").union(fx.part.select("p_type")).union(fx.conversations.select("role"))
    return fx.benchmark.select(F.col("text").alias("name")).union(sentences).union(terms).distinct()


@query("first_match_unique", f"""with {_PAT},
 m as (select d.doc_id, p.name from documents d join pat p on p.name<>'' and contains(lower(d.text), lower(p.name))),
 f as (select name, min(doc_id) as doc_id from m group by name)
select doc_id, min(name) as name from f group by doc_id""")
def _(fx):
    return rt.first_match(rt.contains_pairs(fx.documents, _patterns(fx), "doc_id", "text", "name", "name"), "doc_id", "name")


@query("matched_replies", """
with t as (select p_partkey%7 as request_id, p_partkey as row, p_name||' '||p_brand as id, p_name as term, p_type as genes, p_retailprice as p from part),
 r as (select p_partkey%7 as request_id, p_partkey as place, upper(string_split(p_name,' ')[1]) as name, p_size as rank, p_type as reason from part where p_partkey%9=0),
 m as (select r.place, r.rank, r.reason, t.*, row_number() over (partition by r.request_id, r.place order by t.row) as k from r join t on t.request_id=r.request_id and contains(lower(t.term), lower(r.name))),
 o as (select *, row_number() over (partition by request_id, id order by place) as j from m where k=1)
select request_id, id, term, rank, reason, genes, p from o where j=1""")
def _(fx):
    request = (F.col("p_partkey") % 7).alias("request_id")
    table = fx.part.select(request, F.col("p_partkey").alias("row"), F.concat_ws(" ", "p_name", "p_brand").alias("id"), F.col("p_name").alias("term"),
                           F.col("p_type").alias("genes"), F.col("p_retailprice").alias("p"))
    replies = fx.part.filter("p_partkey % 9 = 0").select(
        request, F.col("p_partkey").alias("place"), F.upper(F.split("p_name", " ")[0]).alias("name"), F.col("p_size").alias("rank"), F.col("p_type").alias("reason"))
    return rt.matched_replies(replies, table)


@query("passages", """
with s as (select doc_id, coalesce(source,'') as title, string_split(text,' ') as w from documents where text is not null),
 b as (select doc_id, title, w, i from s, unnest(range(0, (len(w)-1)//100+1)) as u(i))
select doc_id, title, cast(i as int) as block, trim(array_to_string(w[i*100+1:i*100+100],' ')) as passage from b""")
def _(fx):
    return rt.passages(fx.documents, ["doc_id"], "text", "source")


@query("term_texts", """
select p_partkey, p_name||' [SEP] '||case when p_size%2=0 then p_brand else '' end as text, p_name||chr(10)||p_type as faiss_text from part""")
def _(fx):
    desc = F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))
    return fx.part.select("p_partkey", rt.term_text(F.col("p_name"), desc).alias("text"), rt.term_text(F.col("p_name"), F.col("p_type"), "\n").alias("faiss_text"))


_TASK = "Name the gene of the list that most likely causes the phenotype."
_ANSWER = "Reply with one JSON object that has the keys causal_gene, confidence and reason."
_AGAIN = "The earlier reply %s was not confirmed by %s."


@query("retry_prompts", with_views("variants evidence", f"""
with p as (select snp as request_id, snp, gene_key+(bp%2)*22 as gene, gene_key from variants)
select request_id, '{_TASK} The earlier reply '||cast(gene as varchar)||' was not confirmed by relevant_gene('||cast(gene as varchar)||', '||snp||'). {_ANSWER}' as system,
 'GWAS Phenotype: height'||chr(10)||'Genes: '||array_to_string(list_transform(list_sort(['G'||cast(gene_key as varchar), 'G'||cast(gene_key+22 as varchar)]), lambda x: '{{'||x||'}}'), ',') as "user"
from p where not exists (select 1 from evidence e where e.snp=p.snp and e.gene_key=p.gene)"""))
def _(fx):
    g = F.col("gene_key")
    name = lambda c: F.concat(F.lit("G"), c.cast("string"))
    predictions = fx.variants.select(
        F.col("snp").alias("request_id"), "snp", F.lit("height").alias("phenotype"), F.array(name(g), name(g + 22)).alias("genes"),
        (g + F.col("bp") % 2 * 22).cast("string").alias("causal_gene"))
    proofs = fx.evidence.select("snp", g.cast("string").alias("gene"))
    return rt.prompts(rt.retry_requests(predictions, proofs, "relevant_gene(%s, %s)"), _TASK, _ANSWER, _AGAIN)


@query("prompt_table", f"""
with g as (select l_orderkey, list_sort(list(distinct 'G'||cast(l_partkey as varchar))) as genes from lineitem group by 1)
select o_orderkey as request_id, '{_TASK}'||case when o_orderkey%3=0 then ' The earlier reply G'||cast(o_custkey as varchar)||' was not confirmed by r'||cast(o_custkey as varchar)||'.' else '' end||' {_ANSWER}' as system,
 'GWAS Phenotype: '||o_orderpriority||chr(10)||'Genes: '||array_to_string(list_transform(genes, lambda x: '{{'||x||'}}'), ',') as "user"
from g join orders on o_orderkey=l_orderkey""")
def _(fx):
    # one order is one request; its few lines are the candidate genes around one variant
    genes = fx.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("G"), F.col("l_partkey").cast("string"))).alias("genes"))
    c = F.col("o_custkey").cast("string")
    retry = F.col("o_orderkey") % 3 == 0
    rows = genes.join(fx.orders, genes.l_orderkey == fx.orders.o_orderkey).select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias("phenotype"), "genes",
        F.when(retry, F.concat(F.lit("G"), c)).alias("prev_gene"), F.when(retry, F.concat(F.lit("r"), c)).alias("rule"))
    return rt.prompts(rows, _TASK, _ANSWER, _AGAIN)


def _replies(fx):
    """Model replies rendered from the documents; some are broken, some unlisted."""
    d = fx.documents.join(fx.labels, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("quality", "toxic")})
    k = F.col("doc_id")
    gene = F.when(k % 5 == 0, "GENEX").otherwise(F.concat(F.lit("G"), (k % 7).cast("string")))
    good = F.to_json(F.struct(gene.alias("causal_gene"), (F.col("n_chars") % 100 / F.lit(100.0)).alias("confidence"), F.col("lang").alias("reason")))
    reply = F.when(k % 11 == 0, "sorry, {no json").when(k % 13 == 0, '{"answer": 1}').otherwise(good)
    return d.select("doc_id", F.col("source").alias("dataset"), F.col("lang").alias("model"), reply.alias("reply"),
                    F.concat(F.lit("G"), F.col("quality") + F.col("toxic") * 2).alias("truth"), F.lit("{G0},{G1},{G2},{G10}").alias("genes"))


_REPLY = """
  r as (select d.doc_id, d.source as dataset, d.lang as model, d.n_chars, d.lang, 'G'||cast(coalesce(quality,0)+coalesce(toxic,0)*2 as varchar) as truth,
    '{G0},{G1},{G2},{G10}' as genes, (d.doc_id%11=0 or d.doc_id%13=0) as needs_retry,
    case when d.doc_id%11=0 or d.doc_id%13=0 then null when d.doc_id%5=0 then 'GENEX' else 'G'||cast(d.doc_id%7 as varchar) end as causal_gene
    from documents d left join labels l on l.doc_id=d.doc_id)"""


@query("parsed_replies", f"""with {_REPLY}
select doc_id, causal_gene, case when needs_retry then null else (n_chars%100)/100.0::double end as confidence, case when needs_retry then null else lang end as reason, needs_retry from r""")
def _(fx):
    return rt.parse_replies(_replies(fx)).select("doc_id", "causal_gene", "confidence", "reason", "needs_retry")


@query("reply_scores", f"""with {_REPLY},
 o as (select *, case when contains(genes, causal_gene) then case when causal_gene=truth then 1 else 0 end else -1 end as outcome from r where not needs_retry),
 c as (select dataset, model, count_if(outcome=1)::bigint as correct, count_if(outcome=0)::bigint as incorrect, count_if(outcome=-1)::bigint as unlisted from o group by 1,2),
 s as (select *, case when correct+incorrect>0 then correct/(correct+incorrect)::double end as p, correct/(correct+incorrect+unlisted)::double as rc from c)
select dataset, model, correct, incorrect, unlisted, round(p,6) as precision, round(rc,6) as recall, case when p+rc>0 then round(2*p*rc/(p+rc),6) end as f1 from s""")
def _(fx):
    rows = rt.parse_replies(_replies(fx)).filter("not needs_retry")
    scored = rows.withColumn("outcome", ev.outcome(F.col("causal_gene"), F.col("truth"), F.col("genes")))
    out = ev.precision_recall(scored, ["dataset", "model"])
    return out.select("dataset", "model", "correct", "incorrect", "unlisted", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("mispredictions", f"""with {_REPLY}
select doc_id, truth, causal_gene, causal_gene in ('G0','G1','G2','G10') as listed from r where not needs_retry and truth<>causal_gene""")
def _(fx):
    rows = rt.parse_replies(_replies(fx)).filter("not needs_retry and truth <> causal_gene")
    return rows.select("doc_id", "truth", "causal_gene", ev.is_listed(F.col("causal_gene"), F.col("genes")).alias("listed"))


@query("seeded_sample", """
select doc_id, lang from documents order by md5('42|'||cast(doc_id as varchar)), doc_id limit 100""")
def _(fx):
    return ev.seeded_sample(fx.documents.select("doc_id", "lang"), "doc_id", 100, 42)


@query("id_map", with_views("genes", """
select g.gene_key, h.symbol as gene from genes g join (select gene_id, symbol from genes where gene_key%5<>0) h on h.gene_id=g.gene_id"""))
def _(fx):
    ids = fx.genes.filter("gene_key % 5 <> 0").select(F.lower("gene_id").alias("src"), F.col("symbol").alias("dst"))
    return en.map_ids(fx.genes.select("gene_key", F.col("gene_id").alias("gene")), ids, "gene")


@query("id_map_fallback", with_views("genes", """
select gene_key, case when gene_key%5<>0 then symbol else gene_id end as gene from genes"""))
def _(fx):
    ids = fx.genes.filter("gene_key % 5 <> 0").select(F.lower("gene_id").alias("src"), F.col("symbol").alias("dst"))
    return en.map_ids(fx.genes.select("gene_key", F.col("gene_id").alias("gene")), ids, "gene", keep_unmapped=True)


@query("ordered_lookup", with_views("genes", """
select o_orderkey as batch_id, array_to_string([coalesce(a.gene_id,'-'), coalesce(b.gene_id,'-')], ',') as ids
from orders left join genes a on a.gene_key=o_custkey left join genes b on b.gene_key=o_orderkey"""))
def _(fx):
    key = lambda c: F.concat(F.lit("g"), F.col(c).cast("string"))
    batches = fx.orders.select(F.col("o_orderkey").alias("batch_id"), F.array(key("o_custkey"), key("o_orderkey")).alias("names"))
    found = en.ordered_lookup(batches, fx.genes.select(key("gene_key").alias("name"), F.col("gene_id").alias("id")))
    return found.select("batch_id", F.array_join("ids", ",", "-").alias("ids"))


@query("subset_terms", with_views("variants genes", """
with sig as (select p_brand||'/'||cast(gene_key//66 as varchar) as term, gene_id as gene from genes),
 co as (select distinct v.snp, g.gene_id as gene from variants v join genes g on g.gene_key//22=v.gene_key//22),
 sz as (select term, count(distinct gene) as n from sig group by 1)
select co.snp, sig.term from co join sig on sig.gene=co.gene join sz on sz.term=sig.term group by co.snp, sig.term, sz.n having count(distinct sig.gene)=sz.n"""))
def _(fx):
    sig = fx.genes.select(F.concat_ws("/", "p_brand", F.floor(F.col("gene_key") / 66).cast("string")).alias("term"), F.col("gene_id").alias("gene"))
    block = F.floor(F.col("gene_key") / 22)
    near = fx.variants.select("snp", block.alias("module"))
    return en.subset_terms(sig, fx.genes.select(block.alias("module"), F.col("gene_id").alias("gene")), near)
