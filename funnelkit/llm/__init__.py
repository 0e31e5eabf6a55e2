"""Operators of a training-data pipeline; nothing outside this subpackage imports them."""

import sys

from pyspark import cloudpickle

# Tasks carry this code along, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
