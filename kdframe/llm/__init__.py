"""Training-data operators: thirteen corpus operators, their queries and the helpers they share.

Nothing outside this subpackage imports it.  Functions that run inside Python workers are
shipped by value, so executors need PySpark and the libraries an operator uses, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
