"""ledgerlens: document chunking, retrieval and compliance KPIs as Spark jobs.

Every public function takes DataFrames (or columns) and returns DataFrames
(or columns); nothing here starts a server or keeps state outside Spark.
"""

import sys

from pyspark import cloudpickle

# The few functions that run inside tasks travel with the job, so executors
# need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
