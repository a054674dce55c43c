"""Spark-native analytics for time-aligned media records and training-data pipelines."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
