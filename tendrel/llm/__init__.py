"""Operators for preparing training text. Nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Task code travels with the job, so executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
