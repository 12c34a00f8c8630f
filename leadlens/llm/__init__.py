"""Training-data operators: decontamination, secrets, token counts, toxicity, URL filters, language
identification, exact / SimHash / line deduplication and source mixing.

Nothing outside this package imports it. Functions that run in Python workers are pickled by value, so executors
need numpy, pyarrow and the named third-party modules, but not this package on their path.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
