"""Operators for preparing training text at scale; nothing outside this folder imports them."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with them, so executors need no installed copy of this folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
