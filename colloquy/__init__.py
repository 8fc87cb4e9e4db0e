"""Session analytics on Spark: parse agent session logs, keep them as tables, ask them questions."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
