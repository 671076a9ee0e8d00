"""Claim and record reconciliation as Spark DataFrame operators."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])  # tasks get the library's functions with them
