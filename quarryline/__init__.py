"""Text, graph, vector and event-log analytics as Spark DataFrame operators."""

import os
import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value where the workers can't import this package.
if os.path.dirname(os.path.dirname(os.path.abspath(__file__))) not in os.environ.get("PYTHONPATH", "").split(":"):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
