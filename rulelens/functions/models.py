"""Expressions over model names such as `vendor/name`."""

from pyspark.sql import functions as F

# Fixed value: provider of a model name without a prefix.
DEFAULT_PROVIDER = "openai"


def model_provider(model):
    """Lower-cased part before the first slash."""
    named = F.lower(F.substring_index(model, "/", 1))
    return F.when(model.contains("/"), named).otherwise(F.lit(DEFAULT_PROVIDER))


def model_name(model):
    """Part after the first slash, or the whole name."""
    return F.element_at(F.split(model, "/", 2), -1)
