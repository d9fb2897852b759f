"""Seeds derived from the study seed, and the shuffle that depends on them."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def derive(study_seed: int, purpose: str, key: str) -> int:
    """31 bits from the SHA-256 of `seed:purpose:key`."""
    return int(hashlib.sha256(f"{study_seed}:{purpose}:{key}".encode()).hexdigest()[:8], 16) & 0x7FFFFFFF


def derived(study_seed: int, purpose: str, key: Column | str) -> Column:
    """The same number as a column expression."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.concat_ws(":", F.lit(str(study_seed)), F.lit(purpose), key)
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(0x7FFFFFFF))


def deal(n: int, rng: random.Random) -> list[int]:
    """A permutation of range(n): swaps from the end, indices by rejection of random bits."""
    order = list(range(n))
    for last in range(n - 1, 0, -1):
        width = (last + 1).bit_length()
        pick = rng.getrandbits(width)
        while pick > last:
            pick = rng.getrandbits(width)
        order[last], order[pick] = order[pick], order[last]
    return order


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def shuffled(seed: pd.Series, n: pd.Series) -> pd.Series:
    """The permutation of range(n) that a seed deals. A Mersenne Twister has no counterpart
    among the built-in functions, so this one is Arrow-batched Python."""
    return pd.Series([deal(int(k), random.Random(int(s))) for s, k in zip(seed, n)], dtype=object)
