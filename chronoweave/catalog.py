"""Queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from chronoweave import catalog_batch, catalog_facts, catalog_reason, catalog_text

QUERIES: dict = {**catalog_facts.QUERIES, **catalog_reason.QUERIES, **catalog_text.QUERIES, **catalog_batch.QUERIES}
ORACLE_SQL: dict = {**catalog_facts.ORACLE_SQL, **catalog_reason.ORACLE_SQL, **catalog_text.ORACLE_SQL, **catalog_batch.ORACLE_SQL}


def flagship(spark, sf_dir: str):
    """The best fact of every request under its own time rule: one as-of join."""
    return QUERIES["t_asof_join"](spark, sf_dir)
