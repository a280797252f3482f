"""Tessera: record-catalogue analytics on PySpark (DataFrame, SQL and Catalyst first)."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
