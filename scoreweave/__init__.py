"""scoreweave: a Spark-native engine that scores predictor features against measured responses."""

__version__ = "0.1.0"

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to tasks by value, so executors need no installed copy of it.
_cloudpickle.register_pickle_by_value(__import__(__name__))
