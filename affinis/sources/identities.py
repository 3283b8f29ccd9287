"""Entities to enrich, from the best table there is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from affinis.operators.enrich import identities


def first_identities(candidates: Sequence[DataFrame | None], order: Sequence[Sequence[str]]) -> DataFrame:
    """Identities from the first candidate table that exists and names any entity."""
    for rows, columns in zip(candidates, order):
        if rows is None or "entity_slug" not in rows.columns:
            continue
        if not rows.where("entity_slug <> ''").isEmpty():
            return identities(rows, columns)
    raise FileNotFoundError("no table names any entity")
