"""folioscope: document question-answering analytics on PySpark DataFrames.

Functions that run in Python workers are shipped by value, so executors need
only PySpark and the third-party libraries, not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
