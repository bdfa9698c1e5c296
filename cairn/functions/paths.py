"""Path functions on string columns: separators, parents, components, anchors, volume names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_separators(p: Column) -> Column:
    """Backslashes become slashes."""
    return F.translate(p, "\\", "/")


def trim_slashes(p: Column) -> Column:
    return F.btrim(p, F.lit("/"))


def parent_path(p: Column) -> Column:
    """What stands before the last slash, or the empty string."""
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit(""))


def base_name(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def path_parts(p: Column) -> Column:
    """The non-empty components."""
    return F.filter(F.split(p, "/"), lambda x: x != "")


def first_component(p: Column, prefix: str = "") -> Column:
    """The first component of what follows ``prefix``."""
    return F.substring_index(F.substring(p, len(prefix) + 1, 1 << 30), "/", 1)


def strip_anchor(p: Column) -> Column:
    """Without a drive letter and leading separators."""
    return F.regexp_replace(p, r"^([A-Za-z]:)?[\\/]+", "")


def ancestors(p: Column) -> Column:
    """Every proper ancestor's path, from the root (the empty string) down."""
    parts = path_parts(p)
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def depth(p: Column) -> Column:
    return F.size(path_parts(p))


def volume_name(base: Column | str, number: Column) -> Column:
    """``base.NNN`` with at least three digits."""
    base = F.lit(base) if isinstance(base, str) else base
    digits = number.cast("string")
    return F.concat(base, F.lit("."), F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits))


def volume_number(name: Column) -> Column:
    """The number of a name that ends in a dot and three digits, else null."""
    found = F.regexp_extract(name, r"\.([0-9]{3})$", 1)
    return F.when(found != "", found.cast("int"))


def root_prefix(duplicate: Column, original: Column) -> Column:
    """The first component by which a duplicate's path differs from its original's, else the empty string."""
    first = F.element_at(F.split(duplicate, "/"), 1)
    return F.when(first != F.element_at(F.split(original, "/"), 1), first).otherwise(F.lit(""))
