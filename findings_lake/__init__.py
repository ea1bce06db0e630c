"""findings_lake: a Spark-native engine for code-security findings.

Functions of this package that run inside Spark tasks (``mapInPandas``
bodies) are pickled by value, so executors need neither this package on
their import path nor shipped files.
"""

from pyspark import cloudpickle as _cloudpickle

import findings_lake as _self

_cloudpickle.register_pickle_by_value(_self)
