"""Equity-panel research on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Ship the functions of this package inside the tasks that use them, so that executors
# need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
