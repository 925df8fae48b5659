"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors need not have the package: functions that run there travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
