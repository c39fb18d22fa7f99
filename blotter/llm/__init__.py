"""Operators for preparing training text; nothing else in the library imports them.

Functions of this package that run in Python workers are sent along with the tasks, so that the
executors need no installed copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
