"""titleloom: catalog building from messy names, documents and file lists, on Spark.

Every operator takes DataFrames and returns a DataFrame; nothing is collected,
and wall-clock time is always an explicit ``as_of`` argument so runs repeat.
"""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel by value, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
