"""ledgerscope: balance-risk analytics on Spark DataFrames.

Every public operator takes DataFrames and returns a lazy DataFrame
(no actions inside), built from Spark SQL expressions, windows and
aggregates. MLlib fits are the only eager steps.
"""

import sys as _sys

from ledgerscope.params import RiskParams, DEFAULT_PARAMS

# Python code shipped to executors (pandas UDFs, mapInPandas closures) is
# pickled by value, so workers need no copy of this package on their path.
try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__all__ = ["RiskParams", "DEFAULT_PARAMS"]
