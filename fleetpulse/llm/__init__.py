"""Operators for preparing training text.

Functions of this package reach the executors by value, so a job needs no
installed copy of the package on the workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
