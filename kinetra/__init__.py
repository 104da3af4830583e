"""Pose-sequence analytics and training-set curation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: the few Python functions used in tasks travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
