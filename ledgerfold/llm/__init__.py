"""Operators for training data: language, tokens, mixing, secrets, duplicates, archives and quality."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel by value, so workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
