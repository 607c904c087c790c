"""tessera: code-intelligence analytics and document processing on PySpark.

Functions of this package that run on executors are pickled by value, so that
a cluster needs no installed copy of the package: shipping the driver's code
is enough.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
