"""Spark-first analytics over printed-circuit-board spacing data."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the workers by value, so that executors
# need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
