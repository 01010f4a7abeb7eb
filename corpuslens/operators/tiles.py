"""All-pairs work in tiles: blocks of one side against blocks of the other.

Both sides fall into blocks of a fixed number of rows by a hash; a tile is one
block of each side, so a task's memory does not depend on the size of the
tables, and a tile returns a reduced result instead of its pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tile_apply(left: DataFrame, right: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str, *,
               left_key: str, right_key: str, left_rows: int, right_rows: int) -> DataFrame:
    """``fn(left block, right block)`` of every tile; keys are unique ids."""
    n_left, n_right = (max(1, -(-df.count() // rows)) for df, rows in ((left, left_rows), (right, right_rows)))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("_i", part(left_key, n_left)).withColumn("_j", every(n_right))
    b = right.withColumn("_j", part(right_key, n_right)).withColumn("_i", every(n_left))

    def tile(x: pa.Table, y: pa.Table) -> pa.Table:
        return fn(x, y)

    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInArrow(tile, schema)
