"""Operators for building training data.  Nothing else in the library imports this subpackage.

The modules are pickled by value into the tasks, so executors need the repository on no path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
