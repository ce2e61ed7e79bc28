"""Operators for training-data pipelines. Nothing else in the library imports this package.

Functions of this package that run inside tasks travel with the plan, so executors need the
third-party libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
