"""Training-data operators.

Each module holds one operator with a general interface; ``queries.py`` wires
the thin ``opN_*`` queries. Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so a cluster
# needs no copy of the package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
