"""corpuslint: source-corpus review analytics as Spark jobs over many repositories."""

import sys as _sys

try:  # executors need not have the package installed: ship its functions by value
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__all__ = ["config"]
