"""Automated data analysis on Spark: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the task, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
