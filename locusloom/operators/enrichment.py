"""Over-representation of gene lists in terms, FDR, id maps and term text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.functions import columns as C
from locusloom.functions.running import p_value_bucket, running, salted_join
from locusloom.functions.session import cut_lineage, saved
from locusloom.functions.stats import over_representation_p
from locusloom.operators.tables import paged


def overlap_counts(lists: DataFrame, library: DataFrame, background: DataFrame) -> DataFrame:
    """(list_id, term, overlap, list_size, term_size, universe) with everything cut to the background.

    ``lists(list_id, gene)``, ``library(term, gene)``, ``background(gene)``.
    """
    known = background.select("gene").distinct()
    drawn = lists.select("list_id", "gene").distinct().join(known, "gene", "left_semi")
    terms = library.select("term", "gene").distinct().join(known, "gene", "left_semi")
    hits = drawn.join(terms, "gene").groupBy("list_id", "term").agg(F.count("*").alias("overlap"))
    list_sizes = drawn.groupBy("list_id").agg(F.count("*").alias("list_size"))
    term_sizes = terms.groupBy("term").agg(F.count("*").alias("term_size"))
    universe = known.agg(F.count("*").alias("universe")).scalar()
    return hits.join(list_sizes, "list_id").join(term_sizes, "term").withColumn("universe", universe)


def over_representation(lists: DataFrame, library: DataFrame, background: DataFrame) -> DataFrame:
    """Upper hypergeometric tail and its FDR per (list, term) with at least one shared gene."""
    counts = overlap_counts(lists, library, background)
    p = over_representation_p(*[F.col(c) for c in ("overlap", "list_size", "term_size", "universe")])
    tested = cut_lineage(counts.withColumn("p", p))  # small, and read several times below
    return benjamini_hochberg(tested, ["list_id"], "p", "adjusted_p")


def overlap_genes(lists: DataFrame, library: DataFrame, page_rows: int = 1000) -> DataFrame:
    """Shared genes as ``A;B;...`` text, at most ``page_rows`` genes per (list, term, page)."""
    shared = lists.select("list_id", "gene").distinct().join(library.select("term", "gene").distinct(), "gene")
    slot = F.pmod(F.xxhash64("gene"), F.lit(1024))  # any fixed order will do: pages are sorted inside
    pages = paged(shared, ["list_id", "term"], slot, [F.col("gene")], F.col("gene"), "genes", page_rows)
    return pages.withColumn("genes", F.array_join(F.array_sort("genes"), ";"))


def benjamini_hochberg(df: DataFrame, keys: Sequence[str], p: str, out: str) -> DataFrame:
    """FDR per key; a null p counts as 1.

    Equal p-values share one adjusted value, so the ranks run over distinct p-values with
    counts: rows fold before the shuffle and the join back is salted.
    """
    keys = list(keys)
    filled = df.withColumn("__p", F.coalesce(p, F.lit(1.0)))
    steps = cut_lineage(filled.groupBy(*keys, "__p").agg(F.count("*").alias("__c")))
    ranked = running(steps, keys, p_value_bucket(F.col("__p")), [F.col("__p")], F.col("__c"), "__rank")
    totals = steps.groupBy(*keys).agg(F.sum("__c").alias("__m"))
    raw = ranked.join(totals, keys).withColumn("__raw", F.col("__p") * F.col("__m") / F.col("__rank"))
    adjusted = running(
        raw, keys, p_value_bucket(F.col("__p")), [F.col("__p").desc()], F.col("__raw"), "__adj",
        how="min", descending=True,
    )
    back = adjusted.select(*keys, "__p", F.least("__adj", F.lit(1.0)).alias(out))
    return salted_join(filled, back, [*keys, "__p"]).drop("__p")


def with_term_parts(results: DataFrame, term: str = "term") -> DataFrame:
    """Split ``name (GO:id)`` into id and name."""
    return results.withColumns({"id": C.term_id(F.col(term)), "name": C.term_name(F.col(term))})


def significant_terms(results: DataFrame, alpha: float = 0.05) -> DataFrame:
    return results.filter(F.col("adjusted_p") < alpha)


def attach_description(results: DataFrame, descriptions: DataFrame) -> DataFrame:
    """GO description by id, ``NA`` where there is none."""
    return results.join(descriptions.select("id", "desc"), "id", "left").withColumn("desc", F.coalesce("desc", F.lit("NA")))


def map_ids(df: DataFrame, id_map: DataFrame, column: str, keep_unmapped: bool = False) -> DataFrame:
    """Translate ``column`` through ``id_map(src, dst)``, compared in capitals.

    Unmapped rows drop, or keep their own id with ``keep_unmapped``.
    """
    pairs = id_map.select(F.upper("src").alias("__src"), F.col("dst").alias("__dst"))
    joined = df.join(pairs, F.upper(df[column]) == F.col("__src"), "left" if keep_unmapped else "inner")
    mapped = F.coalesce("__dst", column) if keep_unmapped else F.col("__dst")
    return joined.withColumn(column, mapped).drop("__src", "__dst")


def ordered_lookup(batches: DataFrame, names: DataFrame) -> DataFrame:
    """Look up every name of an array column and give the ids back in the same order.

    ``batches(batch_id, names array)``, ``names(name, id)``; a batch is one request's list.
    """
    asked = batches.select("batch_id", F.posexplode("names").alias("pos", "name"))
    found = asked.join(names.select("name", "id"), "name", "left")
    packed = found.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("x"))
    return packed.select("batch_id", F.transform("x", lambda r: r["id"]).alias("ids"))


def _contained(genes: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """(key, term) whose genes all lie in the set of the key: count shared genes, compare sizes."""
    sizes = genes.groupBy("term").agg(F.count("*").alias("__size"))
    shared = sets.select(key, "gene").distinct().join(genes, "gene").groupBy(key, "term").agg(F.count("*").alias("__n"))
    return shared.join(sizes, "term").filter(F.col("__n") == F.col("__size")).select(key, "term")


def subset_terms(significant: DataFrame, coexpressed: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """(snp, term) whose significant genes all lie in the co-expressed set of the variant.

    ``significant(term, gene)``, ``coexpressed(snp, gene)``. With ``modules(snp, module)`` the genes are given per module,
    ``coexpressed(module, gene)``, and a variant's set is the union over its modules: variants of the same modules
    have one set, which is compared once, so no row per variant and gene is laid out.
    """
    genes = significant.select("term", "gene").distinct()
    if modules is None:
        return _contained(genes, coexpressed, "snp")
    of_variant = modules.filter(F.col("module").isNotNull()).groupBy("snp").agg(F.array_sort(F.collect_set("module")).alias("__modules"))
    of_variant = saved(of_variant, "modules")  # read twice
    sets = of_variant.select("__modules").distinct().withColumn("module", F.explode("__modules")).join(coexpressed, "module")
    found = _contained(genes, sets, "__modules")
    per_set = found.groupBy("__modules").agg(F.collect_list("term").alias("__terms"))  # at most the genes of one set
    return salted_join(of_variant, per_set, ["__modules"]).select("snp", F.explode("__terms").alias("term"))
