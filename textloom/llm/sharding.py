"""Reproducible shuffle into shards: a keyed Feistel permutation of global row numbers.

Rows get a global number in the order of their id. A Feistel network over Z_a x Z_b
(a*b just above the number of rows N) permutes the numbers; values that land at N or
above are fed through again (cycle walking), which keeps the map a permutation of
0..N-1. Position p of the shuffle means shard ``p % shards`` and slot ``p // shards``,
so any reader can compute where a row went, and ``locate`` finds which row is in a slot
without reading anything.

Law ``rows``: shard sizes differ by one row at most and slots have no gaps.

Defined cases: null text has size 1 and CRC 0; null ids sort first; rows equal in id
and text are interchangeable and each get a place of their own; equal texts are not
kept together, as the law is over rows; an empty table gives an empty result; extra
columns are ignored by ``assign`` (which returns only its own columns).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import numbered

ROUNDS = 8


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; uint64 arithmetic wraps."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _round_keys(key: int) -> np.ndarray:
    return _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _network(x: np.ndarray, a: int, b: int, keys: np.ndarray, back: bool = False) -> np.ndarray:
    left, right = x // np.uint64(b), x % np.uint64(b)
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        source, m = (right, a) if r % 2 == 0 else (left, b)
        step = _mix(source + keys[r]) % np.uint64(m)
        step = np.uint64(m) - step if back else step
        if r % 2 == 0:
            left = (left + step) % np.uint64(m)
        else:
            right = (right + step) % np.uint64(m)
    return left * np.uint64(b) + right


def _walk(x: np.ndarray, n: int, key: int, back: bool) -> np.ndarray:
    a, b = sides(n)
    keys = _round_keys(key)
    with np.errstate(over="ignore"):
        x = _network(np.asarray(x, dtype=np.uint64), a, b, keys, back)
        while (out := x >= np.uint64(n)).any():
            x[out] = _network(x[out], a, b, keys, back)
    return x.astype(np.int64)


def permute(row: np.ndarray, n: int, key: int = 0) -> np.ndarray:
    """Place of each global row number in the shuffle."""
    return _walk(row, n, key, back=False)


def locate(place: np.ndarray, n: int, key: int = 0) -> np.ndarray:
    """Global row number at each place: the inverse of ``permute``."""
    return _walk(place, n, key, back=True)


def _order(id_col: str, text_col: str):
    """What rows are numbered by."""
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).cast("long")
    return F.col(id_col).alias("doc_id"), crc.alias("text_crc32"), F.xxhash64(text_col).alias("_h")


def assign(docs: DataFrame, shards: int = 8, key: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, global row number, place, shard and slot.

    Only narrow columns are sorted; texts are read once and never shuffled.
    """
    doc_id, crc, h = _order(id_col, text_col)
    narrow = docs.select(doc_id, (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size"), crc, h)
    rows, n = numbered(narrow, ["doc_id", "_h", "text_crc32"], "shard-rows")

    rows = rows.drop("_h").withColumn("place", _place(n, key))
    return rows.withColumn("shard", _shard(shards)).withColumn("slot", _slot(shards))


def _place(n: int, key: int):
    """The place of ``row_number_global``; only that column goes to Python."""

    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, key) if len(row) else np.zeros(0, np.int64))

    return F.pandas_udf(place, "long")("row_number_global")


def _shard(shards: int):
    return (F.col("place") % shards).cast("int")


def _slot(shards: int):
    return F.expr(f"place div {shards}L")


def write_shards(docs: DataFrame, path: str, shards: int = 8, key: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents themselves, a directory per shard.

    Rows are numbered once and carried along, so that repeated rows and rows without an id
    each keep their place, the one that ``assign`` gives. Columns are those of ``docs``, plus
    ``slot`` and the directory's ``shard`` (with underscores appended where ``docs`` has such
    a column); a file's rows are in the order of their slots.
    """
    names = {}
    for name in ("shard", "slot"):
        while name + names.get(name, "") in docs.columns:
            names[name] = names.get(name, "") + "_"
    shard, slot = ("shard" + names.get("shard", "")), ("slot" + names.get("slot", ""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows, n = numbered(docs.select(row, *_order(id_col, text_col)), ["doc_id", "_h", "text_crc32"], "shard-rows")
    placed = rows.withColumn("place", _place(n, key)).select("row", _shard(shards).alias("shard"), _slot(shards).alias("slot"))
    dealt = placed.repartition("shard", F.expr("slot div 100000")).sortWithinPartitions("shard", "slot")
    dealt.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("slot").alias(slot), F.col("shard").alias(shard)).write.partitionBy(shard).parquet(path)
