"""Operators for training-data pipelines. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value: a cluster needs the third-party
# libraries there, but not this package.
cloudpickle.register_pickle_by_value(sys.modules["tallyweave"])
