"""Removal of boilerplate lines by distinct-site spread (operator 5).

Every line's hash gets a HyperLogLog sketch of the sites it stands on; sketches
are merged by aggregation, so a line on every page costs one row a task.  Lines
whose estimate is clearly above or below the threshold are decided by it; lines
near it, within three standard errors, get an exact distinct count.  A line on
at least ``min_sites`` sites is boilerplate: it stays in the document with the
smallest id that has it and goes from all others, so no text leaves the corpus.

Lines are the pieces between ``\\n``; blanks, tabs and carriage returns around
them do not count for equality, and lines of fewer than ``min_chars`` characters
then are never removed.  Null texts stay null and have no line.  Null sites are
not counted.  A null id is larger than all others.  Repeated rows give repeated
results: rows with equal id and text are decided alike.  A long text costs in
proportion to its lines.  An empty table gives no row.  Only DataFrame
functions run, no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlog.llm.textkit import checkpointed, without

MIN_SITES = 10
MIN_CHARS = 20
LG_K = 12  # sketches of 2^12 registers: a standard error of 1.04 / 2^6
BLANKS = " \t\r"


def _key(id_column: str, text_column: str) -> Column:
    return F.xxhash64(id_column, text_column)


def line_table(docs: DataFrame, min_chars: int, id_column: str, text_column: str, site_column: str) -> DataFrame:
    """``hash, at, site, id, key`` of every line that is long enough."""
    lines = docs.select(
        F.col(id_column).alias("id"), F.col(site_column).alias("site"), _key(id_column, text_column).alias("key"), F.posexplode(F.split(text_column, "\n")).alias("at", "line")
    )
    line = F.trim(F.col("line"), F.lit(BLANKS))
    return lines.filter(F.length(line) >= min_chars).select(F.xxhash64(line).alias("hash"), "at", "site", "id", "key")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``hash, home`` of the lines on at least ``min_sites`` sites; ``home`` is
    the smallest id with the line."""
    spread = lines.groupBy("hash").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min("id").alias("home"))
    margin = 3 * 1.04 / 2 ** (lg_k / 2)
    estimate = F.hll_sketch_estimate("sketch")
    # only what may be boilerplate goes on: few lines, decided once
    maybe = checkpointed(
        spread.filter(estimate >= min_sites * (1 - margin)).select("hash", "home", (estimate > min_sites * (1 + margin)).alias("sure"))
    )
    near = lines.join(maybe.filter("NOT sure").select("hash", "home"), "hash").groupBy("hash", "home").agg(F.countDistinct("site").alias("sites"))
    return maybe.filter("sure").select("hash", "home").unionByName(near.filter(F.col("sites") >= min_sites).select("hash", "home"))


def without_boilerplate(
    docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, id_column: str = "doc_id", text_column: str = "text", site_column: str = "source"
) -> DataFrame:
    """``docs`` with boilerplate lines taken from the text, and the columns
    ``n_lines`` and ``n_removed`` of each row; columns of these names, ``_key``,
    ``_away`` and ``_cut`` in ``docs`` give way."""
    docs = without(docs, "n_lines", "n_removed", "_key", "_away", "_cut")
    lines = checkpointed(line_table(docs, min_chars, id_column, text_column, site_column))
    found = boilerplate(lines, min_sites)
    away = (
        lines.join(found, "hash")
        .filter(~F.col("id").eqNullSafe(F.col("home")))
        .groupBy(F.col("key").alias("_key"))
        .agg(F.collect_set("at").alias("_away"))
    )
    joined = docs.withColumn("_key", _key(id_column, text_column)).join(away, "_key", "left")
    # split once, behind a generator; the lines that stay are found by a hash set, not line by line
    pieces = F.split(F.col(text_column), "\n")
    cut = F.when(F.col("_away").isNotNull(), F.struct(pieces.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), "_away").alias("stay")))
    columns = [F.col(c) for c in docs.columns if c != text_column]
    whole = joined.select(*columns, F.col(text_column), F.coalesce(F.size(pieces), F.lit(0)).alias("n_lines"), F.coalesce(F.size("_away"), F.lit(0)).alias("n_removed"), F.explode(F.array(cut)).alias("_cut"))
    kept = F.array_join(F.transform("_cut.stay", lambda at: F.get(F.col("_cut.lines"), at)), "\n")
    text = F.when(F.col("_cut").isNull(), F.col(text_column)).otherwise(kept)
    return whole.select(*(text.alias(c) if c == text_column else F.col(c) for c in docs.columns), "n_lines", "n_removed")
