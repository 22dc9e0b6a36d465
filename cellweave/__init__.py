"""cellweave: labelled sparse frames and event-stream operators as lazy Spark plans."""

import sys

from pyspark import cloudpickle

# Functions for Python workers carry their code along, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from cellweave.frame import SparseFrame, concat, event_matrix, one_hot, vstack

#: Names under which users of eager and of partitioned sparse frames know these functions. All frames are
#: lazy and partitioned here, so each pair is one function.
sparse_one_hot = one_hot_encode = one_hot
from_pandas = SparseFrame.from_pandas
read_npz = SparseFrame.read_npz

__all__ = ["SparseFrame", "concat", "event_matrix", "from_pandas", "one_hot", "one_hot_encode", "read_npz", "sparse_one_hot", "vstack"]
