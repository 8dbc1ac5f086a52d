"""hanmaru: ingredient analytics and data preparation as pure DataFrame operators on Spark SQL."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions go to the executors by value, so that no executor needs the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
