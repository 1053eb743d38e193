"""Operators for training-data corpora; nothing else in the library imports this package.

Python workers live through many tasks, and what one task's arrays took should not stay with the worker:
large blocks are mapped by themselves, so that the system has them back when they are freed. This is set
in Spark's Python workers only, never in a caller's process.
"""

import ctypes
import sys

import pyarrow as pa
from pyspark import TaskContext

_M_MMAP_THRESHOLD, _M_TRIM_THRESHOLD = -3, -1

if TaskContext.get() is not None and sys.platform == "linux" and hasattr(ctypes.CDLL(None), "mallopt"):
    ctypes.CDLL(None).mallopt(_M_MMAP_THRESHOLD, 4 << 20)
    ctypes.CDLL(None).mallopt(_M_TRIM_THRESHOLD, 8 << 20)
    pa.set_memory_pool(pa.system_memory_pool())
