"""framelane: video-enhancement analytics as Spark tables, operators and streams."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
