"""vectrail: multi-modal retrieval and record processing as Spark plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers carry their code with them, so that a
# cluster needs no copy of this package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
