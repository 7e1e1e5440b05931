"""Training-data operators: one module per operator, their queries in ``queries.py``.

Nothing outside this folder, ``corpus_pipeline.py`` and the guarded block of
``__spark_entry__.py`` imports it.
"""

import sys

from pyspark import cloudpickle

# Functions of this package that run in tasks travel by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
