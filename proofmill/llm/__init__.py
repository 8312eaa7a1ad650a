"""Operators for preparing training data at scale, and the queries that apply them."""

from pyspark import cloudpickle

# Executors need no copy of this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["_"]))
