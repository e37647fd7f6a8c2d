"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage. Functions that run inside
tasks are shipped to the executors by value, so an executor needs no install.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
