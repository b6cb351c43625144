"""Content authenticity scoring and coordinated-campaign detection on Spark."""

import sys

from pyspark import cloudpickle

# task functions travel inside the jobs, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
