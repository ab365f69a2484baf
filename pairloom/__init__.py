"""pairloom: text-pair, triplet and embedding dataset operators on Spark DataFrames.

Every public operator is a function ``DataFrame(s) -> DataFrame``; randomness comes from one
pure hash (``pairloom.functions.hashing.h``) so results are reproducible and replayable in SQL.
"""

import sys as _sys

__version__ = "0.1.0"

# Python functions of this package that run inside Spark tasks (pandas UDFs, applyInPandas,
# mapInPandas) are shipped by value, so executors need no installed copy of the package.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # older cloudpickle: executors must then have the package on their path
    pass
