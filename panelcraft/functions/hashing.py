"""Reproducible random draws.

The original workflow orders by ``RAND()`` (unseeded): every run, and every retried task,
draws differently.  Here each row's random number is a hash of (seed, stage, row key):
the same seed gives the same sample under any partitioning, any retry and any executor
loss, and any SQL engine with ``md5`` reproduces it.

``draw_key`` is the first 13 hex digits (52 bits) of ``md5('seed:stage:k1:k2...')`` as a
BIGINT; ``uniform`` maps it strictly inside (0, 1) so ``ln(uniform)`` is always finite.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = float(2**52)


def _text(k) -> Column:
    c = F.col(k) if isinstance(k, str) else k
    return c.cast("string")


def key_text(seed: int, stage: str, *keys) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), F.lit(stage), *[_text(k) for k in keys])


def draw_key(seed: int, stage: str, *keys) -> Column:
    """Uniform 52-bit BIGINT per row, a pure function of (seed, stage, keys)."""
    return F.conv(F.substring(F.md5(key_text(seed, stage, *keys)), 1, 13), 16, 10).cast("bigint")


def uniform(seed: int, stage: str, *keys) -> Column:
    """Uniform double strictly inside (0, 1)."""
    return (draw_key(seed, stage, *keys).cast("double") + F.lit(0.5)) / F.lit(TWO_POW_52)


def exp_key(weight: Column, seed: int, stage: str, *keys) -> Column:
    """Efraimidis-Spirakis key ``-ln(u) / w``: the k smallest keys are a weighted draw without replacement."""
    return -F.ln(uniform(seed, stage, *keys)) / weight
