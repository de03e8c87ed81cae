"""The registered queries."""

from docweave.plans import corpus_queries, graph_queries, retrieval_queries, service_queries, site_queries, text_queries  # noqa: F401
from docweave.plans.registry import QUERIES, SQL  # noqa: F401
