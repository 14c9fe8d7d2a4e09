"""How many range slices an input needs.

Slices are sized by the measured number of rows (one pruned counting scan),
not by a plan estimate, which multiplies the inputs of a join, and not by the
session's shuffle-partition count. There is no upper limit: a slice holds
about ``ROWS_PER_SLICE`` rows at every input size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

ROWS_PER_SLICE = 1_000_000


def slice_count(df: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> int:
    return max(1, math.ceil(df.count() / rows_per_slice))
