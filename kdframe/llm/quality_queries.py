"""Query of the quality classifier."""

from __future__ import annotations

from . import quality
from .common import read_table
from .queries import register


@register("op10_quality_classifier")
def op10_quality_classifier(spark, sf_dir):
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
