"""Codes, hashes and keys as Column expressions (survey F60-F71)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = (1, 2, 3, 4, 5, 8)  # lengths that account codes may have


def prefixes(code: Column) -> Column:
    """all prefixes of a code, itself included."""
    return F.transform(F.sequence(F.lit(1), F.length(code)), lambda i: F.left(code, i))


def level_prefixes(code: Column, levels: tuple[int, ...] = LEVELS) -> Column:
    """Prefixes at the plan's levels; a shorter code keeps itself."""
    return F.array_distinct(F.array(*(F.left(code, F.lit(n)) for n in levels)))


def level_key(code: Column, level: int) -> Column:
    """The code at a level; shorter codes stay as they are."""
    return F.left(code, F.lit(level))


def account_list(c: Column) -> Column:
    """codes of a list such as "201, (2801), 71*"."""
    parts = F.transform(F.split(c, ","), lambda x: F.regexp_replace(x, r"[()*\s]", ""))
    return F.filter(parts, lambda x: x != "")


def content_key(c: Column) -> Column:
    """F66."""
    return F.sha2(c.cast("binary"), 256)


def unit_draw(key: Column) -> Column:
    """the first eight hex digits of the key's SHA-256, as a share of their largest value."""
    return F.conv(F.left(F.sha2(key.cast("binary"), 256), F.lit(8)), 16, 10).cast("double") / F.lit(4294967295.0)


def split_of(key: Column, val: float, test: float) -> Column:
    """test, val or train, always the same for a key."""
    draw = unit_draw(key)
    return F.when(draw < test, F.lit("test")).when(draw < test + val, F.lit("val")).otherwise(F.lit("train"))


def group_key(by: str, supplier: Column, invoice: Column, document: Column) -> Column:
    """what keeps examples together in a split."""
    if by == "supplier":
        return F.coalesce(F.nullif(supplier, F.lit("")), document.cast("string"))
    if by == "invoice":
        return F.concat_ws("|", supplier, invoice)
    return document.cast("string")


def blind_index(secret: str, normalised: Column) -> Column:
    """a keyed digest that allows equality only. HMAC-SHA-256 spelled out with sha2."""
    key = secret.encode()[:64].ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), normalised.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def fingerprint(*columns: Column) -> Column:
    """a digest of columns in fixed order."""
    return F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256)


def canonical_args(c: Column, defaults: dict[str, str], folded: tuple[str, ...] = ()) -> Column:
    """a JSON object of arguments with defaults filled in, keys sorted and no white space; the arguments in ``folded`` are trimmed and lower case. Null if it is no object."""
    given = F.from_json(c, "map<string,string>")
    preset = F.create_map(*(F.lit(x) for pair in defaults.items() for x in pair)) if defaults else F.create_map().cast("map<string,string>")
    every = F.map_concat(F.map_filter(preset, lambda k, _: ~F.map_contains_key(given, k)), given)
    plain = F.transform_values(every, lambda k, v: F.when(k.isin(*folded), F.trim(F.lower(v))).otherwise(v)) if folded else every
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(plain))))
