"""Training-data operators.

Nothing else in the library imports this subpackage.  Its functions are shipped
to executors by value, so executors need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
