"""tidemark: metrics, logs, traces and alert analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from tidemark.schemas import Naming
from tidemark.session import build_session, configure, scratch_path

# The few functions run in Python workers travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Naming", "build_session", "configure", "scratch_path"]
__version__ = "0.1.0"
