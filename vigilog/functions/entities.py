"""Entities (addresses, users, hosts, e-mails, files, times) of a line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilog import fixed_values as fixed
from vigilog.functions.text import strip, unicode_regex

# A line without these characters cannot hold the entity, so its regex is skipped.
NEEDED_CHARACTERS = {"Email": ["@"], "File": ["/", "\\"]}


def entity_array(line: Column, known_hosts: Sequence[str] = ()) -> Column:
    """Array of (type, ord, entity), types in fixed order, matches left to right.

    A host counts when it holds a dot or is a known host, and is no address.
    """
    parts = [_entities_of(line, kind, pattern, group, known_hosts) for kind, pattern, group in fixed.ENTITY_PATTERNS]
    return F.concat(*parts)


def _entities_of(line: Column, kind: str, pattern: str, group: int, known_hosts: Sequence[str]) -> Column:
    found = F.regexp_extract_all(line, F.lit(unicode_regex(pattern)), F.lit(group))
    if kind == "Host":
        address = unicode_regex("^" + fixed.ENTITY_PATTERNS[0][1])
        known = (lambda h: h.isin(list(known_hosts))) if known_hosts else (lambda h: F.lit(False))
        found = F.filter(found, lambda h: (h.contains(".") | known(h)) & ~h.rlike(address))
    if kind == "File":
        found = F.filter(F.transform(found, strip), lambda f: F.length(f) > 3)
    rows = F.transform(
        found,
        lambda e, i: F.struct(F.lit(kind).alias("type"), i.cast("int").alias("ord"), e.alias("entity")),
    )
    needed = NEEDED_CHARACTERS.get(kind)
    if not needed:
        return rows
    possible = F.lit(False)
    for character in needed:
        possible = possible | line.contains(character)
    none = F.array().cast("array<struct<type:string,ord:int,entity:string>>")
    return F.when(possible, rows).otherwise(none)
