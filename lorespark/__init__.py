"""Spark-native knowledge-base retrieval, document processing and corpus preparation."""

import sys

from pyspark import cloudpickle

# Functions handed to executors travel by value, so workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
