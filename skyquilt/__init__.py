"""skyquilt: spatial-coverage and point-cloud analytics as PySpark DataFrame operators.

Every operator takes and returns DataFrames.  The few Python functions that run
inside tasks are shipped by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
