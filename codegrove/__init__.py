"""codegrove: a Spark-native engine for searching, relating and tracking source code.

Every operator takes DataFrames and parameters and returns a DataFrame; nothing but small, bounded
results (one path, one prompt, one top-k list) ever reaches the driver.
"""

import sys

from pyspark import cloudpickle

# UDF helpers travel with the query, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
