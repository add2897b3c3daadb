"""Training-data operators: language, duplicates, decontamination, privacy, packing, extraction.

Nothing else in the library imports this package. Its functions travel with the tasks, so Python
workers need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules["auctionflow"])
