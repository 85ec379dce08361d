"""Operators for preparing training text, each built by one named method.

Functions that run in Spark's Python workers travel by value, so a cluster needs no installed
copy of this package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
