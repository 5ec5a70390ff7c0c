"""Leading-indicator analytics for catalogue and time-series tables, on Spark.

Every operator is a plain function from DataFrames to a DataFrame.
"""

import sys

from pyspark import cloudpickle

# The few functions that run inside tasks travel with the job, so executors do not
# need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
