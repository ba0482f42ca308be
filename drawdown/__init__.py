"""Spark-native production and reserves analytics over entity time-series."""
import sys

from pyspark import cloudpickle

# Functions used inside Arrow batches travel with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
