"""Convolutional kernel features and ridge / softmax classification on Spark.

Every operator takes DataFrames and returns DataFrames (or a small model that
transforms DataFrames), carries row keys and never relies on row order.
"""

import sys

from pyspark import cloudpickle

# Ship this package inside the task closures, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
