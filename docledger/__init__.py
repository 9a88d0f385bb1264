"""docledger: purchasing-document analytics as lazily evaluated Spark DataFrames.

Functions that run in Python workers are pickled by value, so executors need
neither the repository on their disk nor an entry on their PYTHONPATH.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
