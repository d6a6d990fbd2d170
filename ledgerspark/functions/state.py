"""Stored state read defensively: what has the wrong type is absent, and entries without what they need go."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.lines import array, boolean, number, string


def _entries(v: Column, path: str, fields: dict[str, str], numbers: tuple[str, ...] = ()) -> Column:
    """The array's entries that have all ``fields`` (name to JSON name) in the right type; null if there is no array."""
    read = lambda e, n, j: number(e, j) if n in numbers else string(e, j)
    shaped = F.transform(array(v, path), lambda e: F.struct(*(read(e, n, j).alias(n) for n, j in fields.items())))

    def whole(x: Column) -> Column:
        out = F.lit(True)
        for n in fields:
            out = out & x[n].isNotNull()
        return out

    return F.filter(shaped, whole)


def org_context(raw: Column) -> Column:
    """The organisation part of a state file: null unless it says whether the device is enrolled and when that was checked."""
    v = F.try_parse_json(raw)
    enrolled, checked = boolean(v, "enrolled"), number(v, "checkedAt")
    return F.when(
        enrolled.isNotNull() & checked.isNotNull(),
        F.struct(
            enrolled.alias("enrolled"),
            checked.cast("long").alias("checked_at"),
            string(v, "orgId").alias("org_id"),
            string(v, "teamId").alias("team_id"),
            string(v, "orgLabel").alias("org_label"),
            _entries(v, "attribution.grants", {"grant_id": "grantId", "canonical_id": "canonicalRepoId", "slug": "slug"}).alias("grants"),
            _entries(v, "pendingRequests", {"org_id": "orgId", "slug": "slug", "status": "status", "expires_at": "expiresAt"}, ("expires_at",)).alias("pending"),
        ),
    )


def user_rates(raw: Column) -> Column:
    """A map of user rates from JSON, with only the entries whose input and output are positive numbers in bounds."""
    rates = F.try_variant_get(F.try_parse_json(raw), "$", "map<string, variant>")
    ok = lambda v, n: (number(v, n) > 0) & (number(v, n) <= 10_000)
    kept = F.map_filter(rates, lambda k, v: F.coalesce(ok(v, "input") & ok(v, "output"), F.lit(False)))
    return F.transform_values(kept, lambda k, v: F.struct(*(number(v, j).alias(n) for n, j in (("input", "input"), ("output", "output"), ("cache_read", "cacheRead"), ("cache_write", "cacheWrite")))))
