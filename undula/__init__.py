"""Connectivity dynamics of multichannel time series as Spark jobs.

Every function takes and returns DataFrames in long form; see
``undula.sources.tables`` for the canonical columns.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Array kernels travel to the executors with the job, so workers need no installed copy.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
