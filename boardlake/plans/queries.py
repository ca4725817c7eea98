"""All registered queries (importing the modules fills the registry)."""

from __future__ import annotations

from .registry import REGISTRY, Query


def all_queries() -> dict[str, Query]:
    from . import queries_bidding, queries_cache, queries_codings, queries_feed, queries_feeds, queries_french, queries_hands, queries_misc, queries_more, queries_mp, queries_pages, queries_pipeline, queries_references, queries_results, queries_sd, queries_stream, queries_tables, queries_text  # noqa: F401

    return dict(REGISTRY)
