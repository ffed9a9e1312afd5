"""Ensemble panel analytics on Spark DataFrames.

The central table is ``panel(member, time, gridcell, value)``.  Every operator is a
function ``DataFrame -> DataFrame`` whose column names are arguments.
"""

import sys

from pyspark import cloudpickle

# Send the library's functions to the executors by value, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
