"""corpusmill: corpus preparation for language-model training, on Spark DataFrames."""

from pyspark import cloudpickle as _cloudpickle

# Python functions that run on executors travel by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(__import__(__name__))
