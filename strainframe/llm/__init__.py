"""Operators for large training corpora, one module each, with their registered queries.

Nothing else in the library imports this package. Task functions are shipped
with the query instead of being imported on the executors, so a cluster needs no
copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
