"""Operators for preparing training corpora.  Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to executors by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
