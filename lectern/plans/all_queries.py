"""Every registered query of the library."""

from lectern.plans import card_queries, index_queries, profile_queries, source_queries, state_queries, stream_queries, tag_queries, text_queries, tournament_queries  # noqa: F401
from lectern.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
