"""Stand-in genomic views over the given tables; one SQL text for both engines."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

from locusloom.functions.session import saved

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# name -> (inputs, text); inputs in braces are tables or earlier views
VIEWS: dict[str, str] = {
    "variants": """
        select 'rs'||cast(l_orderkey*10+l_linenumber as string) as snp,
               cast(l_partkey%22+1 as int) as chr,
               l_partkey*5000+l_linenumber*37+l_orderkey%5000 as bp,
               substr('ACGT',cast(l_orderkey%4+1 as int),1) as a1,
               substr('ACGT',cast((l_orderkey+1+l_linenumber%3)%4+1 as int),1) as a2,
               round(0.01+l_discount*4,4) as frq, round((l_discount-0.05)*2,4) as beta,
               round(0.005+l_tax/10,4) as se, l_quantity*l_quantity/200.0 as mlog10p,
               pow(10.0,-(l_quantity*l_quantity/200.0)) as p,
               cast(5000 as bigint) as n, l_partkey as gene_key, l_returnflag, l_linestatus
        from (select *, row_number() over (partition by l_orderkey,l_linenumber
                order by l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount,l_tax,
                         l_shipdate,l_returnflag,l_linestatus) as rn from {lineitem}) t
        where rn=1""",
    "genes": """
        select p_partkey as gene_key, 'ENSG'||lpad(cast(p_partkey as string),11,'0') as gene_id,
               upper(replace(p_name,' ','_'))||'_'||cast(p_partkey as string) as symbol,
               cast(p_partkey%22+1 as int) as chr, p_partkey*5000 as g_start,
               p_partkey*5000+1000+p_size*400 as g_end, p_brand, p_type from {part}""",
    "enhancers": """
        select p_partkey as enh_key, case when p_size%2=0 then 'super_enhancer' else 'enhancer' end as kind,
               cast(p_partkey%22+1 as int) as chr, p_partkey*5000-20000 as e_start,
               p_partkey*5000-18000 as e_end from {part} where p_size%5=0""",
    "associated_with": """
        select e.enh_key, g.gene_key from {enhancers} e join {genes} g on g.gene_key=e.enh_key
        union all
        select e.enh_key, g.gene_key from {enhancers} e join {genes} g on g.gene_key=e.enh_key+22""",
    "tfbs": """
        select p_partkey as tfbs_key, cast(p_partkey%22+1 as int) as chr,
               p_partkey*5000+(p_size*797)%22000 as t_start,
               p_partkey*5000+(p_size*797)%22000+200 as t_end from {part}""",
    "peaks": """
        select cast(p_partkey%22+1 as int) as chr, p_brand as cell_type,
               p_partkey*5000+p_size*20 as start_bp, p_partkey*5000+p_size*20+1500 as end_bp from {part}
        union all
        select cast(p_partkey%22+1 as int), p_brand, p_partkey*5000+p_size*60,
               p_partkey*5000+p_size*60+1500 from {part}""",
    "tads": """
        select gene_key, chr, cast(chr as string)||':'||cast(cast(g_start - g_start%1000000 as bigint) as string) as tad_id
        from {genes}""",
    "evidence": """
        select snp, gene_key, 'eqtl_association' as pred from {variants} where l_returnflag='R'
        union all
        select snp, gene_key, 'activity_by_contact' as pred from {variants} where l_returnflag='A'""",
    "updates": """
        select cast(user_id as string) as hypothesis_id, event_id, ts,
               case event_type when 'signup' then 'Getting candidate genes'
                    when 'view' then 'Predicting causal gene'
                    when 'click' then 'Getting relevant gene proof'
                    when 'purchase' then 'Creating enrich data'
                    else 'Generating hypothesis' end as task,
               case when event_type='error' then 'failed'
                    when event_id%3=0 then 'started' else 'completed' end as state,
               round(value,2) as progress, props as details from {events}""",
}

_DEPENDS = {
    "associated_with": ["enhancers", "genes"],
    "tads": ["genes"],
    "evidence": ["variants"],
}


def _inputs(name: str) -> list[str]:
    text = VIEWS[name]
    return [t for t in [*TABLES, *VIEWS] if "{" + t + "}" in text]


def with_views(names: str, body: str) -> str:
    """DuckDB text: the named views (and what they need) as CTEs before ``body``."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in _DEPENDS.get(name, []):
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    ctes = []
    for name in ordered:
        text = VIEWS[name]
        for t in _inputs(name):
            text = text.replace("{" + t + "}", t)
        ctes.append(f"{name} as materialized ({text})")
    body = body.strip()
    joiner = ",\n" if body.lower().startswith("with ") else "\n"
    if body.lower().startswith("with recursive"):
        return "with recursive " + ",\n".join(ctes) + joiner.replace("\n", " ") + body[len("with recursive"):]
    if joiner.startswith(","):
        return "with " + ",\n".join(ctes) + ",\n" + body[len("with "):]
    return "with " + ",\n".join(ctes) + "\n" + body


class Fixtures:
    """Lazily opened tables and views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in VIEWS:
                inputs = {t: getattr(self, t) for t in _inputs(name)}
                df = self.spark.sql(VIEWS[name], **inputs)
            elif name in TABLES:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
            self._cache[name] = df
        return self._cache[name]

    def once(self, name: str, *columns: str) -> Fixtures:
        """Compute a view that a query reads several times once, with the columns it needs; views made from it read that."""
        self._cache[name] = saved(getattr(self, name).select(*columns), name)
        return self
