"""Code-graph analytics and query engine on PySpark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so that no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
