"""Curating, screening and ranking large libraries of sequence-like items on Spark."""

import sys

from pyspark import cloudpickle

# Python functions sent to executors travel by value, so that executors need
# not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
