"""vigilog: Spark operators for security-log lines.

Sub-packages:

* ``sources``    - file and table scans, sinks, line numbering
* ``functions``  - Column expressions (normalising, field extraction, labels)
* ``operators``  - DataFrame operators (reports, scoring, corrections, training sets)
* ``streaming``  - the scheduled searches as Structured Streaming jobs
* ``plans``      - the registered queries and their reference SQL
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run inside tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
