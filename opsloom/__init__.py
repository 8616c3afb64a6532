"""Serverless operations analytics as Spark DataFrame and Structured Streaming operators."""

import sys

from pyspark import cloudpickle

from opsloom.session import build_session, shared_dir, use_utc

# Python functions of this package travel with the job, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "shared_dir", "use_utc"]
