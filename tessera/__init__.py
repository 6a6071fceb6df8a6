"""tessera: panel time-series analytics expressed as Spark DataFrame plans.

Python functions that run inside executors are pickled by value, so a cluster
needs nothing but PySpark and its libraries installed on the workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
