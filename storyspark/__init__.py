"""Spark-native engine for news, indicator and engagement analytics."""

import sys

from pyspark import cloudpickle

# Ship the few Python functions that run in workers with the job itself, so a
# cluster needs no copy of this package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
