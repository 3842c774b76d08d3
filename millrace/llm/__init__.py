"""Training-data operators: ten Spark jobs over document-like tables.

Functions that run in executors are pickled by value, so a cluster needs no
copy of this package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
