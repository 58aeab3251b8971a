"""Retrieval, record matching and clustering as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task functions travel to the executors with the job, so a cluster needs no copy of this
# package on its machines.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
