"""Process mining on Spark: event logs as DataFrames, models as small objects on the driver."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need not have this package installed: its functions travel with the tasks that call them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
