"""Frame files, parameter files, stored volumes.

What executors run of these modules is sent to them by value.
"""

from pyspark import cloudpickle

from voxelmill import sources as _self

cloudpickle.register_pickle_by_value(_self)
