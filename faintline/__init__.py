"""Time-series anomaly analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from faintline.session import get_spark, settle, shared_folder

# Functions of this package travel to the tasks with the job, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_spark", "settle", "shared_folder"]
