"""A PySpark engine for indexing and searching document collections."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
