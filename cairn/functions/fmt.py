"""Formatting and small scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
#: Labels of frame modes.
MODE_LABELS = {"lz_ext3_gpu": "LZ4 GPU (Extended)", "lz4_gpu": "LZ4 GPU", "lz4": "LZ4", "raw": "RAW (Sem compressão)"}
ATTRIBUTE_MASK = 0x27


def format_bytes(size: Column, decimals: int = 1) -> Column:
    """``5.2 KB``; a null size counts as 0.  Halves round to even, as the exact value has it."""
    size = F.coalesce(size, F.lit(0)).cast("double")
    out = None
    for i, unit in enumerate(UNITS):
        text = F.format_string(f"%.{decimals}f {unit}", F.bround(size / float(1024**i), decimals))
        last = i == len(UNITS) - 1
        if out is None:
            out = F.when(size < 1024, text)
        else:
            out = out.otherwise(text) if last else out.when(size < float(1024 ** (i + 1)), text)
    return out


def truncate(text: Column, n: int) -> Column:
    """At most n characters; a longer text ends in three dots."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 3)), F.lit("..."))).otherwise(text)


def hex_attributes(attrs: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.hex(attrs), 8, "0"))


def epoch_text(seconds: Column) -> Column:
    """UTC time as ``YYYY-MM-DD HH:MM:SS`` (the session's time zone must be UTC)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").otherwise("No")


def ratio(original: Column, compressed: Column) -> Column:
    """1.0 when nothing was compressed."""
    return F.when(compressed > 0, original / compressed).otherwise(F.lit(1.0))


def percent(part: Column, whole: Column) -> Column:
    """0 of nothing is 0 percent."""
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))


def like_any_case(column: Column, pattern: str) -> Column:
    """SQL LIKE without regard to case and without an escape character; a pattern without ``%`` may stand anywhere."""
    pattern = pattern if "%" in pattern else f"%{pattern}%"
    return column.ilike(pattern.replace("\\", "\\\\"))


def mode_label(mode: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in MODE_LABELS.items() for x in kv])
    return F.coalesce(F.element_at(labels, mode), mode)
