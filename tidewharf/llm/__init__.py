"""Operators for large training corpora, as Spark jobs.

Functions that run inside tasks are shipped by value, so executors need the
third-party libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
