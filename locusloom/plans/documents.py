"""Queries on document collections: upsert, patch, delete, look-up, overview."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusloom.functions.session import scratch_path
from locusloom.operators import tables as tb
from locusloom.plans.registry import query
from locusloom.sources.stored import StoredTable


@query("upsert_latest", """
with allv as (select o_custkey as lead_variant_id, o_orderpriority as type, o_orderkey as version, round(o_totalprice,2) as score from orders)
select lead_variant_id, type, version, score from (select *, row_number() over (partition by lead_variant_id, type order by version desc) as rn from allv) t where rn=1""")
def _(fx):
    rows = fx.orders.select(
        F.col("o_custkey").alias("lead_variant_id"), F.col("o_orderpriority").alias("type"),
        F.col("o_orderkey").alias("version"), F.round("o_totalprice", 2).alias("score"))
    half = F.col("version") % 2
    return tb.upsert(rows.filter(half == 0), rows.filter(half == 1), ["lead_variant_id", "type"], [F.col("version").desc()])


@query("stored_changes", """
with allv as (select o_custkey as lead_variant_id, o_orderpriority as type, o_orderkey as version, round(o_totalprice,2) as score from orders),
 newest as (select lead_variant_id, type, version, score from (select *, row_number() over (partition by lead_variant_id, type order by version desc) as rn from allv) t where rn=1)
select lead_variant_id, type, version, score from newest where lead_variant_id%50<>0
union all select lead_variant_id, type, 0, 0.0::double from newest where lead_variant_id%50=0""")
def _(fx):
    # two upserts, one of them twice under its name, and a replacement of some keys, read back from storage
    rows = fx.orders.select(
        F.col("o_custkey").alias("lead_variant_id"), F.col("o_orderpriority").alias("type"),
        F.col("o_orderkey").alias("version"), F.round("o_totalprice", 2).alias("score"))
    spark = rows.sparkSession
    table = StoredTable(spark, scratch_path(spark, "stored"), "lead_variant_id long, type string, version long, score double", ["lead_variant_id", "type"], 16)
    newest, half = [F.col("version").desc(), F.col("score")], F.col("version") % 2
    table.upsert(rows.filter(half == 0), newest, "even")
    table.upsert(rows.filter(half == 1), newest, "odd")
    table.upsert(rows.filter(half == 1).withColumn("version", F.col("version") + 1), newest, "odd")
    some = rows.filter("lead_variant_id % 50 = 0").select("lead_variant_id", "type").distinct()
    table.replace(some.withColumns({"version": F.lit(0).cast("long"), "score": F.lit(0.0)}), ["lead_variant_id", "type"], "reset")
    return table.read()


@query("partial_update", """
select o_orderkey as id, case when o_orderkey%3=0 then 'done' else o_orderstatus end as status,
  case when o_orderkey%9=0 then 'HIGH' else o_orderpriority end as priority from orders""")
def _(fx):
    table = fx.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    changes = table.filter("id % 3 = 0").select("id", F.lit("done").alias("status"), F.when(F.col("id") % 9 == 0, "HIGH").alias("priority"))
    return tb.patch(table, changes, "id", ["status", "priority"])


@query("update_outcome", """
select o_orderkey*2 as id, case when o_orderkey*2 in (select o_orderkey from orders) then 'updated' else 'not found' end as outcome from orders""")
def _(fx):
    table = fx.orders.select(F.col("o_orderkey").alias("id"))
    return tb.patch_outcome(table, fx.orders.select((F.col("o_orderkey") * 2).alias("id")), "id")


@query("owner_delete", """
select o_orderkey as id, o_custkey as user_id from orders where not (o_orderkey%4=0 and o_orderkey%8=0)""")
def _(fx):
    table = fx.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))
    asked = table.filter("id % 4 = 0").withColumn("user_id", F.when(F.col("id") % 8 == 0, F.col("user_id")).otherwise(F.lit(-1)))
    return tb.delete_owned(table, asked, "id", "user_id")


@query("bulk_delete", """
select o_orderkey*3 as id, o_custkey as user_id,
  case when exists (select 1 from orders p where p.o_orderkey=o.o_orderkey*3 and p.o_custkey=o.o_custkey) or o.o_orderkey=0 then 'deleted' else 'failed' end as outcome,
  case when exists (select 1 from orders p where p.o_orderkey=o.o_orderkey*3 and p.o_custkey=o.o_custkey) or o.o_orderkey=0 then null else 'Not found or not authorized' end as reason
from orders o""")
def _(fx):
    table = fx.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))
    asked = table.select((F.col("id") * 3).alias("id"), "user_id")
    return tb.delete_outcome(table, asked, "id", "user_id")


@query("replace_key_rows", """
select o_custkey as hypothesis_id, o_orderkey as step, 'old' as origin from orders where o_custkey%5<>0
union all select o_custkey, max(o_orderkey), 'new' from orders where o_custkey%5=0 group by o_custkey""")
def _(fx):
    table = fx.orders.select(F.col("o_custkey").alias("hypothesis_id"), F.col("o_orderkey").alias("step"), F.lit("old").alias("origin"))
    fresh = table.filter("hypothesis_id % 5 = 0").groupBy("hypothesis_id").agg(F.max("step").alias("step")).withColumn("origin", F.lit("new"))
    return tb.replace_keys(table, fresh, ["hypothesis_id"])


@query("compute_if_absent", """
select c_mktsegment as phenotype, c_custkey as variant, 'created' as outcome from customer where c_custkey not in (select o_custkey from orders)
union all select c_mktsegment, c_custkey, 'reused' from customer where c_custkey in (select o_custkey from orders)""")
def _(fx):
    requests = fx.customer.select(F.col("c_mktsegment").alias("phenotype"), F.col("c_custkey").alias("variant"))
    done = fx.orders.select(F.col("o_custkey").alias("variant")).distinct()
    new = tb.missing_requests(requests, done, ["variant"]).withColumn("outcome", F.lit("created"))
    return new.unionByName(requests.join(done, "variant", "left_semi").withColumn("outcome", F.lit("reused")))


@query("state_snapshot", """
select o_custkey as project, arg_max(o_orderstatus, o_orderkey) as state from orders group by o_custkey""")
def _(fx):
    return tb.latest_snapshot(fx.orders.withColumnRenamed("o_custkey", "project").withColumn("state", F.col("o_orderstatus")), "project", "o_orderkey", "state")


@query("collection_lookup", """
with req as (select c_custkey as request_id, c_custkey as variant, case when c_custkey%2=0 then '1-URGENT' end as phenotype from customer)
select r.request_id, o.o_orderkey as id, o.o_custkey as variant, o.o_orderpriority as phenotype
from req r join orders o on o.o_custkey=r.variant and (r.phenotype is null or r.phenotype=o.o_orderpriority)""")
def _(fx):
    table = fx.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("variant"), F.col("o_orderpriority").alias("phenotype"))
    asked = fx.customer.select(F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("variant"),
                               F.when(F.col("c_custkey") % 2 == 0, "1-URGENT").alias("phenotype"))
    return tb.look_up(asked, table, ["variant", "phenotype"])


@query("hypothesis_status", """
select o_orderkey as id, case when o_orderkey%2=0 and o_orderkey%3=0 then 'completed' when o_orderstatus='F' then 'failed' else 'pending' end as status from orders""")
def _(fx):
    k = F.col("o_orderkey")
    docs = fx.orders.select(
        k.alias("id"), k.alias("enrich_id"), F.when(k % 2 == 0, "GO:1").alias("go_id"), F.when(k % 3 == 0, "text").alias("summary"),
        F.lit("{}").alias("graph"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("started").alias("last"))
    return docs.select("id", tb.hypothesis_status(F.col("last")).alias("status"))


@query("listing_projection", """
select o_orderkey as id, o_orderpriority as phenotype, round(o_totalprice,2) as score,
  case when o_orderkey%2=0 then o_custkey end as enrich_id from orders""")
def _(fx):
    docs = fx.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("phenotype"),
        F.struct(F.round("o_totalprice", 2).alias("score"), F.lit("big").alias("causal_graph"),
                 F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("enrich_id")).alias("result"))
    slim = docs.withColumn("result", F.col("result").dropFields("causal_graph"))
    return slim.select("id", "phenotype", "result.*")


@query("project_overview", """
with o as (select *, row_number() over (partition by o_custkey order by o_orderkey)-1 as k from orders),
 s as (select o_custkey, count(*) as n, arg_max(o_orderstatus, o_orderkey) as state from orders group by 1),
 pages as (select o_custkey, cast(k//10 as bigint) as page, string_agg(cast(o_orderkey as varchar)||'='||o_orderpriority, ';' order by o_orderkey) as hypotheses from o group by 1,2)
select c.c_custkey as project, s.state, coalesce(s.n,0) as n_hypotheses, coalesce(p.page,0) as page, coalesce(p.hypotheses,'') as hypotheses
from customer c left join s on s.o_custkey=c.c_custkey left join pages p on p.o_custkey=c.c_custkey""")
def _(fx):
    hyp = fx.orders.select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("variant"), "o_orderstatus")
    stats = hyp.groupBy("project").agg(F.count("*").alias("n"), F.max_by("o_orderstatus", "id").alias("state"))
    # ids are bucketed by thousands so that a project of any size is numbered by many tasks
    pages = tb.paged(hyp, ["project"], F.floor(F.col("id") / 1000), [F.col("id")], F.struct("id", "variant"), "items", 10)
    text = F.array_join(F.transform("items", lambda x: F.concat(x["id"].cast("string"), F.lit("="), x["variant"])), ";")
    base = fx.customer.select(F.col("c_custkey").alias("project")).join(stats, "project", "left").join(pages, "project", "left")
    zero = F.lit(0).cast("long")
    return base.select("project", "state", F.coalesce("n", zero).alias("n_hypotheses"), F.coalesce("page", zero).alias("page"),
                       F.coalesce(text, F.lit("")).alias("hypotheses"))
