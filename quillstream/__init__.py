"""Spark-native news analytics: feeds and pages in, deduplicated articles, funnels and reports out."""

import sys

from pyspark import cloudpickle

# Executors get the library's functions by value, so they need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
