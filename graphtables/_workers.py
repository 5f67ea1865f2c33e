"""Make functions that run inside Python workers travel with the task.

Functions of the registered modules are pickled by value, so executors do not
need this package installed (the closure carries the code).
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_with_tasks(module_name: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
