"""sparkvec: storing, compressing and exactly searching vector collections on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: a worker needs no copy of this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
