"""The registered queries over the library's own operators, each with its SQL for a second engine."""

from __future__ import annotations

from cairn.plans import catalogs, colouring, files, forms, masks, measures, points, records, scenes, steps
from cairn.plans.registry import QUERIES, SQL

__all__ = ["catalogs", "colouring", "files", "flagship", "forms", "masks", "measures", "oracle_sql", "points", "queries", "records", "scenes", "steps"]

flagship = scenes.flagship


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
