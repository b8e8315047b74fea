"""Spark-native building blocks for data preparation, grouped modelling, outliers, fairness and time-aware validation."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to executors by value, so a cluster doesn't need this package installed on every machine.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
