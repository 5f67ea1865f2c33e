"""Launch script: ``spark-submit run_rank.py PROGRAM ITERS PATH [options]`` (see ``graphtables/__main__.py``).

Spark puts the folder of this script on the driver's path, and the functions that run in
Python workers travel with their tasks, so executors need no copy of the package.
"""

import sys

from graphtables.__main__ import main

if __name__ == "__main__":
    sys.exit(main())
