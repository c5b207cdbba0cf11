"""Query of language identification."""

from __future__ import annotations

from . import langid
from .common import read_table
from .queries import register


@register("op7_language_id")
def op7_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.learn_and_identify(docs).select("doc_id", "held_out", "lang_pred", "score")
