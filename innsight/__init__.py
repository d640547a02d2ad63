"""Peer-relative review analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from innsight.functions import stats as _stats
from innsight.operators import benchmark as _benchmark
from innsight.operators import learn as _learn
from innsight.plans.cluster import Cluster, load_cluster

# Executors get the Arrow functions by value: nothing has to be installed on them.
for _module in (_stats, _benchmark, _learn):
    cloudpickle.register_pickle_by_value(sys.modules[_module.__name__])

__all__ = ["Cluster", "load_cluster"]
