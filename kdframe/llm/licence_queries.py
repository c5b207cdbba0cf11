"""Query of the licence scan."""

from __future__ import annotations

from . import licences
from .common import read_table
from .queries import register


@register("op6_licence_scan")
def op6_licence_scan(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.fit(docs))
