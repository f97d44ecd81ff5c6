"""A PySpark-native engine for airborne point clouds and the terrain, canopy and water derived from them."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors whole, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
