"""Collaborative filtering over rating tables, expressed as Spark jobs.

Ratings are ``(user_id, item_id, rating, ts)``; matrices are sparse cell
tables ``(row, col, value)``; factor tables are ``(id, features)``.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no local install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
