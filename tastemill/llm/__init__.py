"""Operators that prepare text for training language models.

Functions of this package travel to the workers by value, so that executors
need the libraries but not the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
