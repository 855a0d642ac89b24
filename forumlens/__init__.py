"""PySpark operators for studying threaded discussions next to opinion surveys."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run in Python workers travel whole, so the package need not be installed on executors
cloudpickle.register_pickle_by_value(sys.modules[__name__])
