"""Event-graph analytics on Spark: sources, functions, operators, plans and streaming."""

import sys

from pyspark import cloudpickle

# Executors need not have the package: functions that run there travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
