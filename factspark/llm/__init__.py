"""Operators for preparing training data: ten operators, their queries and their SQL.

Nothing else in the library imports this subpackage.  Functions that run inside Python
workers are shipped by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
