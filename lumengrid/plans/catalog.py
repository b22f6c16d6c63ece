"""Collects the registered queries of the image operators."""

from __future__ import annotations


def queries() -> dict:
    from . import file_queries, image_queries

    return image_queries.QUERIES | file_queries.QUERIES


def oracle_sql() -> dict:
    from . import file_queries, image_queries

    return image_queries.ORACLES | file_queries.ORACLES
