"""looma: Spark-native jobs that prepare, score and measure tabular learning tasks."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors whole, so no executor needs it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
