"""The registered queries over the reference's own operators."""

from skein.plans import code_queries, diff_queries, find_queries, graph_queries, link_queries, source_queries, text_queries  # noqa: F401
from skein.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
