"""Lap telemetry and training-data operators on PySpark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors whole, so they need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
