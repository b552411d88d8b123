"""Symbols of venues as pairs, and the parts of a pair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quote assets that end a symbol, the longest first.
SUFFIXES = ("USDT", "USDC", "BUSD", "USD")


def split_suffix(symbol: Column, suffixes: tuple[str, ...] = SUFFIXES, base_required: bool = True) -> Column:
    """BASE-QUOTE for a symbol that ends in a known quote asset, else the symbol, in capitals."""
    upper = F.upper(symbol)
    out = upper
    for s in reversed(suffixes):
        fits = upper.endswith(s) & (F.length(upper) > len(s) if base_required else F.lit(True))
        out = F.when(fits, F.concat(F.substring(upper, F.lit(1), F.length(upper) - len(s)), F.lit(f"-{s}"))).otherwise(out)
    return out


def base_of(pair: Column) -> Column:
    """What stands before the last dash; empty without one."""
    return F.regexp_extract(pair, r"^(.*)-[^-]*$", 1)


def quote_of(pair: Column) -> Column:
    """What stands after the last dash."""
    return F.substring_index(pair, "-", -1)
