"""Retrieval analytics on Spark: every operator is a function from DataFrames to DataFrames."""

import sys

from pyspark import cloudpickle

from quarrylight.session import build_session

# Task functions travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
