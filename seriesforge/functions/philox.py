"""Counter-based random numbers: Philox with two 32-bit words and ten rounds.

A draw is a function of its place (two 32-bit counters) and a key, so any member,
bin or step is drawn alone, in any task, and drawn again the same. The rounds
are given for arrays, and as SQL text for Spark and for other engines.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published multiplier, key step and number of rounds.
MULTIPLIER = 0xD256D193
KEY_STEP = 0x9E3779B9
ROUNDS = 10
WORD = 0xFFFFFFFF
UNIFORM_BITS = 52  # a middle of 2^52 cells of (0, 1): neither end occurs

SPARK = {"xor": "({0} ^ {1})", "right": "shiftright({0}, {1})", "word": "CAST(conv(substr(md5({0}), 1, 8), 16, 10) AS BIGINT)"}
ANSI = {"xor": "xor({0}, {1})", "right": "({0} >> {1})", "word": "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"}


def words(first, second, key) -> tuple[np.ndarray, np.ndarray]:
    """The two output words of each pair of counters."""
    a, b, k = (np.asarray(x, np.uint64) & np.uint64(WORD) for x in (first, second, key))
    for _ in range(ROUNDS):
        product = a * np.uint64(MULTIPLIER)
        a, b = (product >> np.uint64(32)) ^ k ^ b, product & np.uint64(WORD)
        k = (k + np.uint64(KEY_STEP)) & np.uint64(WORD)
    return a, b


def uniform(first, second, key) -> np.ndarray:
    """Numbers between 0 and 1."""
    a, b = words(first, second, key)
    return ((a * np.uint64(1 << 20) + (b >> np.uint64(12))).astype(float) + 0.5) / float(1 << UNIFORM_BITS)


def _round(number: int, dialect: dict[str, str]) -> tuple[str, str]:
    """Both words after a round, from columns _a, _b and _k; the product is made of halves that fit 63 bits."""
    right = dialect["right"].format
    high = f"({MULTIPLIER} * {right('_a', 16)})"
    low = f"({MULTIPLIER} * (_a & 65535) + ({high} & 65535) * 65536)"
    top = f"({right(high, 16)} + {right(low, 32)})"
    key = f"((_k + {number * KEY_STEP % (1 << 32)}) & {WORD})"
    return dialect["xor"].format(dialect["xor"].format(top, key), "_b"), f"({low} & {WORD})"


def _fraction(dialect: dict[str, str]) -> str:
    return f"((_a * 1048576 + {dialect['right'].format('_b', 12)}) + 5e-1) / {float(1 << UNIFORM_BITS)!r}"


def with_uniform(df: DataFrame, name: str, first: Column, second: Column, key: Column) -> DataFrame:
    """The rows with a number between 0 and 1 drawn at their counters."""
    start = lambda c: c.cast("long").bitwiseAND(F.lit(WORD))
    out = df.select("*", start(first).alias("_a"), start(second).alias("_b"), start(key).alias("_k"))
    for i in range(ROUNDS):
        a, b = _round(i, SPARK)
        out = out.select(*df.columns, F.expr(a).alias("_a"), F.expr(b).alias("_b"), "_k")
    return out.select(*df.columns, F.expr(_fraction(SPARK)).alias(name))


def uniform_sql(source: str, columns: str, name: str, first: str, second: str, key: str) -> str:
    """The same as SQL text: a sub-select of ``columns`` of ``source`` and ``name``."""
    cell = lambda x: f"(CAST({x} AS BIGINT) & {WORD})"
    out = f"SELECT {columns}, {cell(first)} AS _a, {cell(second)} AS _b, {cell(key)} AS _k FROM {source}"
    for i in range(ROUNDS):
        a, b = _round(i, ANSI)
        out = f"SELECT {columns}, {a} AS _a, {b} AS _b, _k FROM ({out})"
    return f"(SELECT {columns}, {_fraction(ANSI)} AS {name} FROM ({out}))"


def key_sql(text: str, seed: int, dialect: dict[str, str] = ANSI) -> str:
    """Key of a stream: the seed and the first word of a text's MD5."""
    return dialect["xor"].format(dialect["word"].format(text), seed & WORD)
