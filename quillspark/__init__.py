"""A Spark-first analytics engine for questionnaire fidelity studies.

Functions and operators take and return DataFrames or Columns; nothing here runs an action
unless its docstring says so.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Workers get the functions themselves, so executors need no copy of this package on their path.
register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
