"""Source-corpus analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers whole, so they need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
