"""Tabulon: a Spark-native tabular analytics engine written against the DataFrame API.

Functions that Spark ships to Python workers are pickled by value, so executors need PySpark and the
libraries they import, but no copy of this package on their path.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
