"""A Spark-native engine for document knowledge bases."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so that those need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
