"""Queries of the near-duplicate operators."""

from __future__ import annotations

from . import passages, simhash
from .common import read_table
from .queries import register


@register("op1_simhash_near_dedup")
def op1_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select("doc_id", "fingerprint", "component_id")


@register("op2_substring_dedup")
def op2_substring_dedup(spark, sf_dir):
    """One row for each passage that a document shares with the one that keeps it."""
    found = passages.repeated_passages(read_table(spark, sf_dir, "documents"))
    return found.drop("d", "kept_d")
