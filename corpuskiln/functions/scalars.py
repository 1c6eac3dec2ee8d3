"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_KB = 1024


def parse_size(text: Column) -> Column:
    """``64MB`` -> bytes: KB, MB or GB in any case, fractions allowed, cut down to whole bytes."""
    upper = F.upper(F.trim(text))
    number = F.regexp_extract(upper, r"^([0-9.]+)", 1).cast("double")
    unit = F.when(upper.endswith("GB"), _KB**3).when(upper.endswith("MB"), _KB**2).when(upper.endswith("KB"), _KB).otherwise(1)
    return F.floor(number * unit).cast("long")


def human(n: Column, last: str = "PB") -> Column:
    """Bytes with one decimal and a unit up to ``last``, without a space; null for null.

    The decimal is the nearest to the exact binary value, halves to even, as C and Python
    print it; ``format_string`` would round halves of the shortest decimal up.
    """
    value = n.cast("double")
    units = ("B", "KB", "MB", "GB", "TB", "PB")
    units = units[: units.index(last) + 1]
    shown = [F.concat(F.call_function("format_number", value / float(_KB**power), F.lit("0.0")), F.lit(unit)) for power, unit in enumerate(units)]
    out = shown.pop()
    for power, text in reversed(list(enumerate(shown))):
        out = F.when(F.abs(value) < float(_KB ** (power + 1)), text).otherwise(out)
    return out


def human_short(n: Column) -> Column:
    """Bytes as whole B, then one decimal up to GB."""
    value = n.cast("double")
    return (
        F.when(value < _KB, F.format_string("%d B", n.cast("long")))
        .when(value < _KB**2, F.format_string("%.1f KB", value / _KB))
        .when(value < _KB**3, F.format_string("%.1f MB", value / _KB**2))
        .otherwise(F.format_string("%.1f GB", value / _KB**3))
    )


def tier_bytes(tier: Column) -> Column:
    """Bytes that a tier's name says; 0 for unknown units."""
    number = F.regexp_extract(tier, r"^([0-9.]+)", 1).try_cast("double")
    unit = F.when(tier.endswith("GB"), float(_KB**3)).when(tier.endswith("MB"), float(_KB**2)).when(tier.endswith("KB"), float(_KB)).otherwise(0.0)
    return F.coalesce(number * unit, F.lit(0.0))


def pipeline(tokenizer: Column, packing: Column) -> Column:
    return F.when(tokenizer == "none", "raw").otherwise(F.concat(tokenizer, F.lit("+"), packing))


def number(x: Column, digits: int = 4) -> Column:
    """Fixed decimals, ``-`` for null."""
    return F.when(x.isNull(), "-").otherwise(F.format_string(f"%.{digits}f", x))


def signed(value: Column, percent: Column, unit: str = "%%") -> Column:
    """A change with its sign beside the relative one: ``+0.1234 (+5.6%)``; ``-`` for null."""
    return F.when(value.isNull() | percent.isNull(), "-").otherwise(F.format_string(f"%+.4f (%+.1f{unit})", value, percent))


def compressor_input(packed: Column, packing: Column, corpus: Column, tokens: Column) -> Column:
    """Bytes handed to the compressor: recorded, or rebuilt where that is exact, else null."""
    return F.coalesce(F.nullif(packed, F.lit(0)), F.when(packing == "raw_utf8", corpus).when((packing == "fixed_u16") & (tokens > 0), tokens * 2))


def blocks_rounded(fed: Column, dictionary: Column) -> Column:
    """Blocks by half-even rounding of input over twice the dictionary, at least one."""
    return F.greatest(F.lit(1), F.rint(fed / (2 * dictionary)).cast("long"))


def blocks_ceil(fed: Column, dictionary: Column) -> Column:
    """Blocks that really come out."""
    return F.greatest(F.lit(1), F.ceil(fed / (2 * dictionary)).cast("long"))


def xz_block_size(dictionary: Column, threads: Column) -> Column:
    return F.greatest(dictionary * 2, F.floor(dictionary * 2 * F.least(threads, F.lit(4)) / 4).cast("long"))


def batch_default(available: Column, chunk: Column) -> Column:
    """Chunks in a batch: a quarter of the free memory over five chunks each, within 4 and 128."""
    raw = F.floor(F.floor(available * 0.25) / (chunk * 5))
    return F.least(F.greatest(F.lit(4), raw), F.lit(128)).cast("int")


def feasible(free: Column, tier: Column) -> Column:
    """Whether a tier fits the free disk three and a half times."""
    return free >= tier * 3.5


def threads_supported(version: Column) -> Column:
    """Whether an xz version text is 5.2.0 or later."""
    part = lambda k: F.regexp_extract(version, r"(\d+)\.(\d+)\.(\d+)", k).try_cast("int")
    return F.coalesce(F.struct(part(1), part(2), part(3)) >= F.struct(F.lit(5), F.lit(2), F.lit(0)), F.lit(False))


def scrub_path(text: Column, marker: str = "corpus") -> Column:
    """Absolute paths before the marker folder are cut away; a second pass changes nothing."""
    return F.regexp_replace(text, rf"(?:[A-Za-z]:)?(?:[/\\]+[^/\\\"\s]+)*[/\\]+{marker}[/\\]+", f"{marker}/")


def upper_median(values: Column) -> Column:
    """The element in the middle of the sorted array, the upper one of two; null if empty."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))
