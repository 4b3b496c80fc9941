"""barline: a PySpark-native engine for time-series market research.

Functions of this package that run on executors are shipped by value, so a cluster
needs no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
