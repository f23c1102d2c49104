"""Training-data operators: thirteen jobs over ``documents``, ``pages``, ``conversations`` and ``embeddings``.

Nothing else in the library imports this subpackage; its registered queries are in
:mod:`logsieve.llm.queries`, the staged corpus pipeline is ``corpus_pipeline.py`` at the top.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors with the tasks that call them, so a
# cluster needs no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
