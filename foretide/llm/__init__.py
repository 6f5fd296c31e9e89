"""Training-data operators: mixing, search, quality, joins, tokenizers, stores and models.

Nothing outside this subpackage imports it.  Functions that run in Python workers are shipped
by value, so executors need only the third-party libraries, not this repository.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
