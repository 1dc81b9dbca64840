"""Text-corpus and topic-model work on Spark DataFrames."""

from corpusloom.config import (
    TopicParams,
    batch_profile,
    multicore_profile,
    multicore_trial_profile,
    spark_profile,
    spark_trial_profile,
)
from corpusloom.session import build_session

__all__ = [
    "TopicParams",
    "batch_profile",
    "build_session",
    "multicore_profile",
    "multicore_trial_profile",
    "spark_profile",
    "spark_trial_profile",
]
