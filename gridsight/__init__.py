"""gridsight: table profiling, cleaning, statistics and chart data as Spark jobs."""
import sys

from pyspark import cloudpickle

# Ship our functions with the tasks, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
