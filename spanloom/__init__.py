"""Retrieval evaluation and training-data operators for Spark.

Functions that run in Python workers travel by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
