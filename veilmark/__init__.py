"""Reversible tokenization of personal data on Spark."""

import sys

from pyspark import cloudpickle

# Python helpers travel to executors by value, so the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
