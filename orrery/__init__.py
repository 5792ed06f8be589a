"""Spark-native graph, spatial and record analytics on DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors are sent along, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
