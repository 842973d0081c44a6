"""The filled registry: importing this module registers all queries."""

from inkfold.plans import file_queries, lexicon_queries, mask_queries, text_queries, vector_queries
from inkfold.plans.registry import ORACLE_SQL, QUERIES

MODULES = (file_queries, lexicon_queries, mask_queries, text_queries, vector_queries)
__all__ = ["MODULES", "ORACLE_SQL", "QUERIES"]
