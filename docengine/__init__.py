"""docengine: analytics over documentation page corpora, on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in workers travel inside the plan, so the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
