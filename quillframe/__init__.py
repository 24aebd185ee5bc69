"""A PySpark-native analytics engine: a compact frame layer, statistics, metrics, preprocessing, learning and array functions."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so that a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
