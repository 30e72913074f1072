"""Text-signal event studies as Spark jobs: documents in, evidence out."""
import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
