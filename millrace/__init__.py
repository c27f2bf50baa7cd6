"""millrace: a Spark-first engine for building, searching and refining text corpora."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the plan, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
