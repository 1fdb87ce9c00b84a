"""Canonical JSON, content keys and list digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """Compact JSON of an object, keys in order; null fields are written."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def content_key(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def digest_joined(ids: Column, separator: str = "\n") -> Column:
    """SHA-256 of ids with separators between them."""
    return F.sha2(F.array_join(ids, separator), 256)


def digest_terminated(ids: Column, terminator: str = "\n") -> Column:
    """SHA-256 of ids, each followed by the terminator."""
    return F.sha2(F.concat(F.array_join(ids, terminator), F.when(F.size(ids) > 0, terminator).otherwise("")), 256)


def order_hash(seed: int, *keys: Column) -> Column:
    """A seeded pseudo-random order that any SQL engine can repeat."""
    return F.md5(F.concat(F.lit(str(seed)), *[F.concat(F.lit(":"), F.coalesce(k.cast("string"), F.lit(""))) for k in keys]))


def private_fields(columns: list[str], denied: frozenset[str] = frozenset({"positive_classes", "trigger_methods", "labels"})) -> list[str]:
    """Denied columns among those of a table that is about to be published."""
    return sorted(denied.intersection(columns))
