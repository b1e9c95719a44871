"""Training-data operators. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Executors get the operators' functions by value: nothing has to be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
