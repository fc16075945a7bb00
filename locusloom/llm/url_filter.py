"""URL block and allow lists by hashed host-suffix and path-prefix expressions.

A rule (host, path, action) fits its host and every subdomain of it when the URL's path starts with the rule's path.
Each URL is expanded into host suffix + path prefix texts, only for the label counts and path lengths that some rule
has; texts meet rules on the first 32 bits of their SHA-256 and are confirmed by the whole digest. The longest fitting
rule decides, then the longer host, then allow before block; a URL that no rule fits is allowed.

Defined results: a null URL, or one without ``://``, has empty host and path and is allowed; a host is kept as written
but for A-Z (user part and port stay in it and so may keep a rule from fitting); repeated rows, null and repeated ids
keep their own row; an empty table or rule list works; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.llm.registry import query, table

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url)))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _hashed(df: DataFrame, text: str) -> DataFrame:
    """Adds ``digest`` and ``short``, its first 32 bits."""
    return df.withColumn("digest", F.sha2(text, 256)).withColumn("short", F.substring("digest", 1, 8))


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Every suffix of ``host`` with one of ``labels`` label counts + prefix of ``path`` of one of ``lengths``."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in labels]).cast("array<int>"), lambda n: (n <= F.size(parts)) & (host != "")),
        lambda n: F.array_join(F.slice(parts, -n, n), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(path)),
        lambda n: F.substring(path, F.lit(1), n),
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) per row of ``pages``; ``rules``: host, path, action (allow or block)."""
    listed = _hashed(
        rules.filter("host is not null and path is not null and action is not null")
        .select(F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), "action"), "rule",
    )
    shape = rules.select(
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")
    ).first()  # at most as many numbers as a host has labels, and a path characters
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    texts = urls.select(
        "host", "path", F.explode(expressions(F.col("host"), F.col("path"), sorted(shape.labels), sorted(shape.lengths))).alias("text")
    )
    met = _hashed(texts, "text").join(listed.withColumnRenamed("digest", "full"), "short").filter("digest = full")
    best = met.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule"), "host_length", F.col("action") == "allow", "rule", "action")).alias("best")
    ).select("host", "path", "best.rule", "best.action")
    return urls.join(best, ["host", "path"], "left").select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict")
    )


RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]

_SQL = f"""
with rules(rhost, rpath, action) as (values {", ".join(map(str, RULES))}),
urls as (
    select row_number() over () as row_id, page_id,
           translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_UPPER.lower()}') as host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
    from pages),
fits as (
    select row_id, rhost || rpath as rule, action,
           row_number() over (partition by row_id order by length(rhost || rpath) desc, length(rhost) desc) as place
    from urls join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(action, 'allow') as verdict
from urls left join (select * from fits where place = 1) using (row_id)"""


@query("op7_url_filter", _SQL)
def _url_filter(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge(table(spark, sf_dir, "pages", "page_id", "url"), rules)
