"""A Spark-native engine for corpora of books and other structured documents."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so that workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
