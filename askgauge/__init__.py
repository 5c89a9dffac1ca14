"""Workload evaluation for text-to-SQL on Spark."""

import sys

from pyspark import cloudpickle

# Ship helper functions with the tasks, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
