"""weftline: ETL mapping transformations as plain Spark DataFrame operators.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); Catalyst and AQE pick the physical plan.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel whole, so that executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
