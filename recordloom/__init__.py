"""Entity matching and record linkage on Spark."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions inside the tasks, so they need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
