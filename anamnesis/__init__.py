"""Batch memory retrieval, maintenance and evaluation as PySpark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside Arrow tasks travel by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
