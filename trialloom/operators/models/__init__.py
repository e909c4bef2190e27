"""Models whose data passes are distributed aggregates and whose solves are small and dense."""

import ctypes
import os
from pathlib import Path

import numpy as np


def _one_blas_thread() -> None:
    """Keep the small dense solves on one thread.

    They gain nothing from more, fits already run side by side, and a threaded BLAS in a process that also
    forks (as a Spark driver does) can stall.
    """
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    setters = ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads")
    for folder in (Path(np.__file__).parent / ".libs", Path(np.__file__).parent.parent / "numpy.libs"):
        for lib in folder.glob("*openblas*"):
            handle = ctypes.CDLL(str(lib))
            for name in setters:
                if hasattr(handle, name):
                    getattr(handle, name)(1)


_one_blas_thread()
