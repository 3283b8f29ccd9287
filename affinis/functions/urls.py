"""Slugs and codes out of page addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from affinis.functions.text import blank_to_null, col, safe_slug

_ADDRESS = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)"


def slug_from_url(url: Column | str, hosts: Sequence[str], prefix: str) -> Column:
    """Slug of a base page `//host/<prefix>/<slug>`, null for every other address.

    Hosts compare exactly, port and user part included; `*.name` accepts subdomains.
    """
    host = F.regexp_extract(col(url), _ADDRESS, 1)
    path = F.regexp_replace(F.regexp_extract(col(url), _ADDRESS, 2), r";[^/]*$", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    exact = [h for h in hosts if not h.startswith("*.")]
    known = F.lit(False)
    if exact:
        known = known | host.isin(*exact)
    for wild in (h for h in hosts if h.startswith("*.")):
        known = known | host.endswith(wild[1:])
    return F.when(known & (F.size(parts) == 2) & (F.get(parts, F.lit(0)) == prefix),
                  blank_to_null(F.get(parts, F.lit(1))))


def set_code_from_uri(uri: Column | str) -> Column:
    """Set code out of a card address `/card/<code>/`, null when there is none."""
    code = F.regexp_extract(col(uri), r"(?i)/card/([^/]+)/", 1)
    return F.when(code != "", safe_slug(code))
