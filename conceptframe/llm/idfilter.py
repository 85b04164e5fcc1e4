"""A Bloom filter of ids, so that a join shuffles only the rows that can meet them.

The cells that ids hit are gathered as bitmaps by SQL functions. The filter decides no result: it lets
through every row whose id is there, and what it lets through is joined exactly. A filter of more than
`FILTER_BYTES` is not sent; then all rows are joined. A null is an id like others.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS_AN_ID, HASHES = 16, 4
BITMAP = 1 << 15  # cells of one bitmap of the SQL functions
FILTER_BYTES = 32 << 20
U64 = np.uint64


def possible(ids: DataFrame, column: str, most: int = FILTER_BYTES) -> Callable[[Column], Column] | None:
    """Whether a value can be among `ids` (a written table), as a condition on a Column; None beyond `most` bytes."""
    count = ids.count()
    bitmaps = -(-max(count, 1) * CELLS_AN_ID // BITMAP)
    if bitmaps * BITMAP // 8 > most:
        return None
    cells = bitmaps * BITMAP
    both = ids.select(F.xxhash64(column).alias("h")).select(F.shiftrightunsigned("h", 32).alias("a"), F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"))
    hit = both.select(F.explode(F.array(*[1 + F.pmod(F.col("a") + k * F.col("b"), F.lit(cells)) for k in range(HASHES)])).alias("cell"))
    found = hit.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    plane = np.zeros(cells // 8, np.uint8)
    for row in found.toLocalIterator():
        start = (row.bucket - 1) * BITMAP // 8
        plane[start:start + BITMAP // 8] = np.frombuffer(bytes(row.bits), np.uint8)
    sent = ids.sparkSession.sparkContext.broadcast(plane)

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        h = hashes.to_numpy(np.int64).view(U64)
        a, b = h >> U64(32), h & U64(0xFFFFFFFF)
        out = np.ones(len(h), bool)
        for k in range(HASHES):
            cell = ((a + U64(k) * b) % U64(cells)).astype(np.int64)
            out &= ((sent.value[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).astype(bool)
        return pd.Series(out)

    return lambda value: test(F.xxhash64(value))


def without(rows: DataFrame, key: str, ids: DataFrame, most: int = FILTER_BYTES) -> DataFrame:
    """Rows whose key is not among `ids` (a written table with the column `key`); null keys stay."""
    can = possible(ids, key, most)
    if can is None:
        return rows.join(ids, key, "left_anti").select(*rows.columns)
    held = rows.filter(can(F.col(key))).join(ids, key, "left_anti").select(*rows.columns)
    return rows.filter(~can(F.col(key))).unionByName(held)
