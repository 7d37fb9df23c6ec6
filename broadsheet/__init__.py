"""Broadsheet: corpus mining on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions travel to the Python workers with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
