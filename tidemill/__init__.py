"""Tidemill: time-series and numerical analytics over Spark DataFrames.

`Series` with `vec` (series operators) and `ta` (indicators), `scalar` and `reductions` (column functions), `mat` (linear
algebra), `rollers` (stateful, also for streams) and `bars` (a source)."""

from tidemill.functions import reductions, scalar
from tidemill.operators import indicators as ta
from tidemill.operators import matrix as mat
from tidemill.operators import series as vec
from tidemill.operators.series import Kernel, Series
from tidemill.sources.bars import bars
from tidemill.streaming import rollers

__all__ = ["Kernel", "Series", "bars", "mat", "reductions", "rollers", "scalar", "ta", "vec"]
