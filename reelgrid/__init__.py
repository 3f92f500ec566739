"""Spark-first analytics for catalogues of media records.

Functions of this package that run in Python workers travel by value, so
executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
