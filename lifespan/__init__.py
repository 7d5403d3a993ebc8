"""Remaining-life analytics for degradation telemetry, written for Spark."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so executors do not need
# this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
