"""Text-recognition analytics and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Spark's Python workers travel with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
