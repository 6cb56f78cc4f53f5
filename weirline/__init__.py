"""weirline: panel time-series analytics on Spark DataFrames.

A panel holds one row per (section, date). Every public function takes and
returns DataFrames and works on all sections at once.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
