"""Analytics, audit, reconciliation and migration operators for record data, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions sent to executors travel by value: no executor needs this package on its path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
