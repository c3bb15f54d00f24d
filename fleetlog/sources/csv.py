"""CSV logs in, validated DataFrames out.

Files are read with every column as text, bound by header *name* (extra
columns ignored); the required set is checked on ``df.columns``.  Row numbers
follow the original's ``index + 2`` (header = row 1, a record that reaches over
several lines counts once) per file and are computed without putting a whole
file in one task when the file is splittable: rows are counted per (file,
split), the splits' offsets come from a window over that small table, and each
row adds its position in its split: its id less the split's first one.

A record may reach over line ends inside quotes.  Splits start at line ends, so
a file with such a record has to be read whole; which files those are is told by
the quotes of their lines: a line with an odd number of them leaves a record
open (escaped quotes are doubled and change nothing).  Only these files are read
unsplit, the others stay split by lines.

A record's identity over a folder is one number, ``row_num``: the file's ordinal
(by path) shifted by ``FILE_SHIFT`` bits plus the record's number in it.  For the
first or only file that is the number itself.  It orders rows and names the
partners of pairs; issues show the file and the number in the file.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlog.operators import rules
from fleetlog.schema import (
    ERROR, FUEL_RAW_COLUMNS, FUEL_SCHEMA, ISSUE_SCHEMA, KEY, ODO_RAW_COLUMNS, ODO_SCHEMA, ROW, TANK_STATES, TS,
)


def _reader(spark: SparkSession, multiline: bool):
    # enforceSchema off: a file of a folder whose header differs from the first one's fails the
    # read, where Spark would otherwise bind its columns by position
    return (spark.read.option("header", True).option("enforceSchema", False).option("multiLine", multiline).option("quote", '"')
            .option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "")
            .option("encoding", "UTF-8").option("mode", "PERMISSIVE"))


def number_rows(df: DataFrame, first: int = 2) -> DataFrame:
    """Per-file ordinal of the data records, starting at ``first``."""
    d = (df.withColumn("_file", F.col("_metadata.file_path"))
         .withColumn("_split", F.col("_metadata.file_block_start"))
         .withColumn("_mid", F.monotonically_increasing_id()))
    # ids rise by one inside a split, so a row's place needs its first id only, no sort of the split
    splits = d.groupBy("_file", "_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_file", "_split", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # a row for each split, which the driver lists for the scan anyway; so no file's rows meet in a task
    return (d.join(F.broadcast(offsets), ["_file", "_split"])
            .withColumn(ROW, (F.col("_off") + F.col("_mid") - F.col("_first") + first).cast("long"))
            .drop("_split", "_mid", "_first", "_off", "_metadata"))


FILE_SHIFT = 40


def _source(path: Column) -> Column:
    """A file's address as ``DataFrame.inputFiles`` writes it."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def open_line_files(spark: SparkSession, path: str) -> list[str]:
    """Files with a record that goes on behind a line end: those with a line of an odd
    number of quotes.  Lines are judged where they are read; what meets is one row a file."""
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    found = lines.filter(quotes % 2 == 1).select(F.col("_metadata.file_path").alias("file")).distinct()
    return sorted(r.file for r in found.collect())


def _read(spark: SparkSession, path: str, required: tuple[str, ...], multiline: bool | None) -> DataFrame:
    """Numbered rows; files with open lines are read whole, the others in splits."""
    whole = open_line_files(spark, path) if multiline is None else []

    def numbered(multi: bool, files: list[str] | None, inside: bool = True) -> DataFrame:
        df = _reader(spark, multi).csv(path).select(*required, "_metadata")
        if files:
            chosen = F.col("_metadata.file_path").isin(*files)
            df = df.filter(chosen if inside else ~chosen)      # prunes the scan's file list
        return number_rows(df)

    if multiline or (whole and len(whole) == len(_reader(spark, False).csv(path).inputFiles())):
        return numbered(True, None)
    if not whole:
        return numbered(False, None)
    return numbered(False, whole, inside=False).unionByName(numbered(True, whole))


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """``file_no, source_file`` of a folder's files, in the order of their path."""
    files = sorted(_reader(spark, False).csv(path).inputFiles())
    return spark.createDataFrame(list(enumerate(files)), "file_no long, source_file string")


def with_source(rows: DataFrame, files: DataFrame, row: str = ROW) -> DataFrame:
    """``rows`` with ``source_file`` and ``record``, the number in the file, of their ``row`` id."""
    of = F.shiftrightunsigned(F.col(row), FILE_SHIFT) == F.col("file_no")
    return (rows.join(F.broadcast(files), of, "left").drop("file_no")
            .withColumn("record", F.col(row).bitwiseAND(F.lit((1 << FILE_SHIFT) - 1))))


def _dataset_issue(spark: SparkSession, dataset: str, message: str) -> DataFrame:
    return spark.createDataFrame([(dataset, None, ERROR, "file", None, None, message)], ISSUE_SCHEMA)


def read_raw_csv(spark: SparkSession, path: str, required: tuple[str, ...], dataset: str,
                 multiline: bool | None = None) -> tuple[DataFrame | None, DataFrame]:
    """Read a CSV log as text columns with ``row_num`` (the record id over all files) and
    ``source_file``.

    Returns ``(rows or None, file issues)``: a missing file, an empty file or
    missing required columns give one dataset-level error and no rows.
    Quoted newlines are found and handled by file; ``multiline`` fixes the way of reading
    instead (True: every file whole, False: every file by lines).  All files of a folder
    must have the same header line.
    """
    empty_issues = spark.createDataFrame([], ISSUE_SCHEMA)
    try:
        cols = _reader(spark, bool(multiline)).csv(path).columns
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            return None, _dataset_issue(spark, dataset, f"File not found: {path}")
        raise
    if not cols:
        return None, _dataset_issue(spark, dataset, f"Empty or malformed CSV: {path}")
    missing = sorted(set(required) - set(cols))
    if missing:
        return None, _dataset_issue(spark, dataset, f"Missing required columns: {missing}")
    rows = _read(spark, path, required, multiline).withColumn("source_file", _source(F.col("_file"))).drop("_file")
    rows = rows.join(F.broadcast(source_files(spark, path)), "source_file")
    return rows.withColumn(ROW, F.shiftleft("file_no", FILE_SHIFT) + F.col(ROW)).drop("file_no"), empty_issues


def _with_issue_columns(issues: DataFrame, keys: list[str]) -> DataFrame:
    out = issues
    for c in ("pair_row_a", "pair_row_b", "pairs"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(1 if c == "pairs" else None).cast("long"))
    if "rule_seq" not in out.columns:
        out = out.withColumn("rule_seq", F.lit(0))
    for c in ("source_file", "pair_file_a"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.select(*keys, "dataset", "severity", "rule", "rule_seq", ROW, "field", "message",
                      "pair_row_a", "pair_row_b", "pairs", "source_file", "pair_file_a")


def _located(issues: DataFrame, files: DataFrame) -> DataFrame:
    """Record ids to files and numbers: ``source_file`` is that of the row, of a pair that of
    its later row; ``pair_file_a`` that of the earlier one."""
    low = F.lit((1 << FILE_SHIFT) - 1)
    a = files.select(F.col("file_no").alias("_no_a"), F.col("source_file").alias("pair_file_a"))
    of = F.shiftrightunsigned(F.coalesce(ROW, "pair_row_b"), FILE_SHIFT)
    out = issues.join(F.broadcast(files), of == F.col("file_no"), "left").join(
        F.broadcast(a), F.shiftrightunsigned("pair_row_a", FILE_SHIFT) == F.col("_no_a"), "left")
    return out.withColumns({c: F.col(c).bitwiseAND(low) for c in (ROW, "pair_row_a", "pair_row_b")}).drop("file_no", "_no_a")


def _no_rows(spark, schema, file_issues, keys, vehicle_id) -> rules.Validated:
    """A file-level failure: empty good rows (schema kept) and the one issue."""
    good = spark.createDataFrame([], schema)
    if keys:
        issues = file_issues.withColumn(KEY, F.lit(vehicle_id).cast("long"))
    else:
        good, issues = good.drop(KEY), file_issues.drop(KEY)
    return rules.Validated(good, _with_issue_columns(issues, keys))


def load_fuel_csv(spark: SparkSession, path: str, vehicle_id: int | None = None,
                  config: rules.RuleConfig = rules.RuleConfig(), multiline: bool | None = None) -> rules.Validated:
    """CSV fuel log -> validated rows and issues.

    With ``vehicle_id`` the rows get that key; otherwise the whole input is one log.
    ``row_num`` of the rows is the record id (``with_source`` gives its file and number);
    the issues name the file and have the number in it."""
    rows, file_issues = read_raw_csv(spark, path, FUEL_RAW_COLUMNS, "fuel", multiline)
    keys = [KEY] if vehicle_id is not None else []
    if rows is None:
        return _no_rows(spark, FUEL_SCHEMA, file_issues, keys, vehicle_id)
    if keys:
        rows = rows.withColumn(KEY, F.lit(vehicle_id).cast("long"))
    v = rules.validate_fuel(rows.drop("source_file"), keys, config)
    return rules.Validated(v.good, _with_issue_columns(_located(v.issues, source_files(spark, path)), keys))


def load_odometer_csv(spark: SparkSession, path: str, vehicle_id: int | None = None,
                      config: rules.RuleConfig = rules.RuleConfig(), multiline: bool | None = None) -> rules.Validated:
    """CSV odometer log -> validated rows and issues."""
    rows, file_issues = read_raw_csv(spark, path, ODO_RAW_COLUMNS, "odometer", multiline)
    keys = [KEY] if vehicle_id is not None else []
    if rows is None:
        return _no_rows(spark, ODO_SCHEMA, file_issues, keys, vehicle_id)
    if keys:
        rows = rows.withColumn(KEY, F.lit(vehicle_id).cast("long"))
    v = rules.validate_odometer(rows.drop("source_file"), keys, config)
    return rules.Validated(v.good, _with_issue_columns(_located(v.issues, source_files(spark, path)), keys))


def table_rows_to_fuel(entries: DataFrame) -> DataFrame:
    """Stored fuel rows -> fuel records: null notes -> '', unknown tank text -> 'unknown' (S12)."""
    tank = F.when(F.col("is_full_tank").isin(*TANK_STATES), F.col("is_full_tank")).otherwise(F.lit("unknown"))
    return (entries.withColumn("notes", F.coalesce(F.col("notes"), F.lit("")))
            .withColumn("is_full_tank", tank)
            .withColumn("price_per_liter_eur", F.try_divide("amount_eur", "liters")))


def table_rows_to_odometer(entries: DataFrame) -> DataFrame:
    """Stored odometer rows -> odometer records with '' for null notes."""
    return entries.withColumn("notes", F.coalesce(F.col("notes"), F.lit("")))


def ordered(df: DataFrame, keys: list[str] | None = None, descending: bool = False) -> DataFrame:
    """Sort for output only (S11): by keys, then time and row number."""
    keys = [KEY] if keys is None else list(keys)
    t = [F.col(TS).desc(), F.col(ROW).desc()] if descending else [F.col(TS), F.col(ROW)]
    return df.orderBy(*keys, *t)
