"""factspark: facts about large collections of source workspaces and documents.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns).  Nothing here owns a session, collects rows or keeps state.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
