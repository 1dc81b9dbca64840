"""Operators of a training-data pipeline. Nothing else in the package imports this folder."""

from pyspark import cloudpickle

import corpusloom

# Functions that run in tasks travel with their code: executors need not have this package.
cloudpickle.register_pickle_by_value(corpusloom)
