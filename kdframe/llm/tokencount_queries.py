"""Query of the token counts."""

from __future__ import annotations

from . import tokencount
from .common import read_table
from .queries import register


@register("op5_token_counts")
def op5_token_counts(spark, sf_dir):
    return tokencount.token_counts(read_table(spark, sf_dir, "documents"))
