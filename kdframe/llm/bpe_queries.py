"""Query of byte-pair encoding and decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe
from .common import read_table
from .queries import register


@register("op12_bpe_round_trip")
def op12_bpe_round_trip(spark, sf_dir):
    back = bpe.decode(bpe.encode(read_table(spark, sf_dir, "documents")))
    return back.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
