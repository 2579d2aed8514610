"""Bitemporal fact analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package go to the executors by value: nothing has to be installed or shipped there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
