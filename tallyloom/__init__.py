"""tallyloom: batch analytics operators and jobs on plain PySpark.

Every public function takes and returns DataFrames (or a thin record around
one) and leaves planning to Spark.
"""

import sys

from pyspark import cloudpickle

# The few functions that run inside Python workers are shipped by value, so
# executors do not need this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
