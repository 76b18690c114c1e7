"""All registered queries."""

from pairstone.plans import box_queries, card_queries, chat_queries, fact_queries, form_queries, glyph_queries, link_queries, matching_queries, pass_queries, reader_queries, store_queries, stream_queries, template_queries  # noqa: F401
from pairstone.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
