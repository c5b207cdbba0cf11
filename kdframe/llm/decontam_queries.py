"""Query of the decontamination operator."""

from __future__ import annotations

from . import decontam
from .common import read_table
from .queries import register


@register("op9_benchmark_decontamination")
def op9_benchmark_decontamination(spark, sf_dir):
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
