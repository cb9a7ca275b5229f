"""A Spark-native engine for retrieval, text analytics and training-data preparation."""

import sys

from pyspark import cloudpickle

# tasks carry the package's functions by value, so executors needn't have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
