"""Analytics over versioned document corpora, property records and text collections, on Spark."""

import os
import sys
from pathlib import Path

from pyspark import cloudpickle

# Python workers import this package if it is on their path; otherwise functions travel with their code.
if str(Path(__file__).resolve().parents[1]) not in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
