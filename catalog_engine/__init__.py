"""Versioned file catalogs as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Task functions travel with their job: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
