"""Completion analytics on Spark: every operator takes and returns a DataFrame."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions sent to Python workers carry their code, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
