"""Operators for large training-data corpora, and the queries built on them.

Nothing else in the library imports this subpackage.  Its functions are sent to
the executors by value, so a cluster needs no copy of it on the workers.
"""

from pyspark import cloudpickle

from voxelmill import llm as _self

cloudpickle.register_pickle_by_value(_self)
