"""A PySpark-native engine for scoring, curating and analysing QA and language-model data."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers are pickled by value, so executors don't need this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
