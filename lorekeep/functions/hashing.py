"""Fingerprints that need 64-bit wrap-around, as Arrow functions, and rankings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of FNV-1a, 64 bits.
OFFSET, PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


def fnv1a(data: bytes, state: int = OFFSET) -> int:
    for byte in data:
        state = ((state ^ byte) * PRIME) & MASK
    return state


def fingerprint(parts: list[str]) -> str:
    """Parts hashed in order, each closed by a unit separator."""
    state = OFFSET
    for part in parts:
        state = fnv1a(b"\x1f", fnv1a(part.encode(), state))
    return f"{state:016x}"


@F.pandas_udf(StringType())
def fnv_hex(x: pd.Series) -> pd.Series:
    """16 hex digits of a string; null stays null."""
    return x.map(lambda v: None if v is None else f"{fnv1a(v.encode()):016x}")


@F.pandas_udf(StringType())
def fingerprint_hex(parts: pd.Series) -> pd.Series:
    return parts.map(lambda v: None if v is None else fingerprint(["" if p is None else p for p in v]))


def temporal_score(age: Column, half_life: float = 30.0) -> Column:
    """1 for age 0 or less, halved each half-life, 0 for an unknown age."""
    import math

    return F.when(age.isNull(), 0.0).when(age <= 0, 1.0).otherwise(F.exp(F.lit(-math.log(2) / half_life) * age))


def proximity_score(hops: Column, falloff: float = 0.5) -> Column:
    return F.when(hops.isNull(), 0.0).otherwise(F.pow(F.lit(min(1.0, max(0.0, falloff))), hops))


class Weights:
    """Weights of a blend: each in 0..1, with the sum 1."""

    def __init__(self, structural: float = 0.4, temporal: float = 0.3, intent: float = 0.3):
        own = (structural, temporal, intent)
        if any(not 0 <= w <= 1 for w in own) or abs(sum(own) - 1) > 0.001:
            raise ValueError(f"weights must lie in 0..1 and sum to 1: {own}")
        self.structural, self.temporal, self.intent = own

    def blend(self, structural: Column, temporal: Column, intent: Column) -> Column:
        return self.structural * structural + self.temporal * temporal + self.intent * intent
