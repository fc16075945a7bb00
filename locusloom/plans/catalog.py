"""Imports every query module, which fills the registry."""

from locusloom.plans import documents, files, finemapping, scores, streams, studies, sumstats, terms, variant_gene  # noqa: F401
from locusloom.plans.variant_gene import flagship  # noqa: F401
