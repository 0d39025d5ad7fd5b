"""Order statistics of sliding windows at a cost that does not grow with the window.

A series is cut into chunks of rows with the rows before them (its halo), by positions that no
single task gives out. In a chunk a wavelet matrix (functions.counts) answers all windows at once.

Defined results: rows without a value count as rows of the window, not as values; a window with
fewer values than least has no percentile; ties count as not exceeding; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.counts import window_shares
from . import ranges
from .windows import DATE, SERIES

#: Rows of a chunk, besides those before it.
CHUNK_ROWS = 50_000


def chunks(df: DataFrame, rows: int, halo: int, *, series: Sequence[str] = SERIES, order: Sequence[str] = (DATE,)) -> DataFrame:
    """df with pos (in its series), chunk and is_halo: pieces of rows rows, each with the halo rows before it. No task holds a series; rows is halo at least."""
    rows = max(rows, halo)
    placed = ranges.positions(df, order, "pos", series=series)
    home = F.floor(F.col("pos") / rows)
    dealt = F.when(F.col("pos") % rows >= rows - halo, F.array(home, home + 1)).otherwise(F.array(home))
    return placed.withColumn("chunk", F.explode(dealt)).withColumn("is_halo", F.col("chunk") != home)


def sliding_percentiles(df: DataFrame, x: str, windows: Mapping[str, int], least: int, *, inclusive: bool = False, series: Sequence[str] = SERIES, order: Sequence[str] = (DATE,), rows: int = CHUNK_ROWS) -> DataFrame:
    """df with windows.prior_percentile of x (windows.percentile if inclusive) for windows of any sizes, by name."""
    cut = chunks(df, rows, max(windows.values()), series=series, order=order)
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in windows]])
    sizes = {c: (n, inclusive) for c, n in windows.items()}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos", kind="stable")
        found = window_shares(part[x].to_numpy(dtype=float, na_value=np.nan), sizes, least)
        keep = ~part["is_halo"].to_numpy()
        out = part.loc[keep].drop(columns=["pos", "chunk", "is_halo"])
        return out.assign(**{c: s[keep] for c, s in found.items()})

    made = cut.groupBy(*series, "chunk").applyInPandas(run, schema)
    return made.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in windows})
