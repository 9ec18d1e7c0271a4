"""Training-data operators: quality rules, mixing, chat formatting, language id,
token counts, toxicity, decontamination, line dedup, URL filters, near dedup by MinHash and by
SimHash, whitening, clustering."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors whole, so they need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
