"""Operators of a training-data pipeline, and their registered queries.

Functions of this package that run inside tasks are sent along with the job, so executors
need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
