"""sheetwise: table cleaning, profiling and business analyses as lazy Spark DataFrame functions.

Every operator takes DataFrames and returns DataFrames (or a small dict of them); only bounded
summaries (a handful of statistics, a list of at most a few thousand quantile boundaries, a fitted
model) ever reach the driver.
"""

import sys as _sys

try:  # ship this package's functions inside pickled UDFs, so executors need no install
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: the package must be installed on executors
    pass

from sheetwise.session import checkpoint_dir, get_session  # noqa: E402

__all__ = ["get_session", "checkpoint_dir"]
