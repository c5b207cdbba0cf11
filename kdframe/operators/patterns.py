"""Substring-any flags (re-aimed layer freezing): a row is flagged iff any pattern occurs in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_patterns(spark: SparkSession, path: str, key: str = "unfrozen_parameters") -> DataFrame:
    """(pattern) from a YAML file: the items (``- text``) of the list under ``key``."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line"))
    own = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)       # one small file
    head = F.when(F.col("line").rlike(r"^[^\s#-][^:]*:"), F.regexp_extract("line", r"^([^:]+):", 1))
    item = F.regexp_extract("line", r"^\s*-\s+(['\"]?)(.*?)\1\s*$", 2)
    return (lines.withColumn("head", F.last(head, ignorenulls=True).over(own)).withColumn("pattern", item)
            .where((F.col("head") == key) & (F.col("pattern") != "")).select("pattern"))


#: Letters of the pieces that patterns are looked up by.
PIECE = 3


def _pieces(text: Column, size: int) -> Column:
    """The different substrings of ``size`` characters, none if the text is shorter."""
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size)))))


def matches(df: DataFrame, col: str, patterns: DataFrame, pattern_col: str = "pattern") -> DataFrame:
    """(name, pattern): each different name with each pattern it contains.

    An inverted index: a pattern is filed under the piece of three characters that the fewest names
    have (a shorter one under itself), names are joined by their pieces, and what meets is verified.  Work
    follows the names that share a pattern's rarest piece, for a list of any size.
    """
    pats = patterns.select(F.col(pattern_col).alias("pattern")).where(F.col("pattern") != "").distinct()
    names = df.select(F.col(col).alias("name")).where(F.col("name").isNotNull()).distinct()
    size = F.least(F.length("pattern"), F.lit(PIECE))
    sizes = sorted(r[0] for r in pats.select(size.alias("size")).distinct().collect())      # at most PIECE numbers
    if not sizes:
        return names.select("name", F.lit(None).cast("string").alias("pattern")).limit(0)
    all_pieces = lambda c: F.flatten(F.array(*[F.coalesce(_pieces(F.col(c), n), F.array().cast("array<string>")) for n in sizes]))
    by_piece = names.select("name", F.explode(all_pieces("name")).alias("piece"))
    own = F.coalesce(*[F.when(size == n, _pieces(F.col("pattern"), n)) for n in sizes])
    wanted = pats.select("pattern", F.explode(own).alias("piece"))
    count = by_piece.join(wanted.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("n"))
    rarest = (wanted.join(count, "piece", "left").groupBy("pattern")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("_r"))
              .where("_r.n > 0").select("pattern", F.col("_r.piece").alias("piece")))
    return by_piece.join(rarest, "piece").where(F.contains("name", "pattern")).select("name", "pattern")


def pattern_flag(df: DataFrame, col: str, patterns: DataFrame, out: str = "flag",
                 pattern_col: str = "pattern") -> DataFrame:
    """``any(p in name for p in patterns)`` as a boolean column (see ``matches``).  Null names and null
    patterns match nothing; an empty pattern is in every name."""
    hit = matches(df, col, patterns, pattern_col).select(F.col("name").alias("_name")).distinct().withColumn("_hit", F.lit(True))
    empty = patterns.where(F.col(pattern_col) == "").agg((F.count("*") > 0).alias("_empty"))        # one row
    both = df.join(hit, F.col(col) == F.col("_name"), "left").crossJoin(F.broadcast(empty))
    return both.withColumn(out, F.coalesce("_hit", F.col("_empty") & F.col(col).isNotNull())).drop("_name", "_hit", "_empty")


def pattern_rows(df: DataFrame, col: str, patterns: DataFrame, keep: bool = True,
                 pattern_col: str = "pattern") -> DataFrame:
    """Rows whose ``col`` contains any pattern (``keep``) or none."""
    flagged = pattern_flag(df, col, patterns, "_flag", pattern_col)
    return flagged.where(F.col("_flag") if keep else ~F.col("_flag")).drop("_flag")
