"""Tidemark: set-based analytics operators written as Spark DataFrame plans.

Sub-packages
------------
``sources``    readers and writers (Parquet, CSV, TSV, JSON, text, binary)
``functions``  Column expressions (text, numbers, JSON, time)
``operators``  DataFrame -> DataFrame operators
``streaming``  Structured Streaming versions of the cache operators
``plans``      the named queries, each with its SQL counterpart
"""

import sys

from pyspark import cloudpickle

from tidemark.session import build_session, scratch_path

__all__ = ["build_session", "scratch_path"]

# Functions used inside tasks travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
