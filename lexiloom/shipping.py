"""Task code travels with the job, so executors need not have this package installed."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module_name: str) -> None:
    """Send the functions and classes of a module by value."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
