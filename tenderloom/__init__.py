"""Document retrieval, question answering and evaluation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so that executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
