"""Persisted fuel/odometer tables and report outputs.

A log is a folder with ``data/batch=<id>`` and ``commits/batch=<id>``.  A write
puts its rows into a batch folder of its own and then one commit record, a
single small file; readers take the batches that are committed.  So a write that
is killed anywhere leaves rows that nobody reads, and running it again, under the
same batch id, replaces them.  A batch id that is committed is never written
again: without one, the id is a hash of the rows, so the same rows appended
twice count once.  ``compact_log`` writes the committed batches as one, whose
record says which ones it replaces.

Inside a batch rows are partitioned by event month and by a hash bucket of the
keys, sorted by keys and time, with a Bloom filter on the keys: a period
prunes months, a vehicle prunes buckets before any file is opened and row groups
by their statistics, the roles of the original store's indexes on
``car_id`` and ``datetime``.  Appended entries are few rows: they are written
by month alone (bucket ``ANY``), and get their buckets when the log is compacted.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from fleetlog.functions.calendar import Period
from fleetlog.operators import rules
from fleetlog.operators.lookups import import_missing
from fleetlog.schema import FUEL_SCHEMA, KEY, TS
from fleetlog.session import checkpoint_dir

MONTH_COL = "event_month"
BUCKET_COL = "key_bucket"
BUCKETS = 16
ANY = -1      # bucket of rows that are not dealt by their keys
COMMIT = "batch_id string, rows long, replaces array<string>, schema_json string"


def _bucket(keys: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*[k.cast("string") for k in keys]), F.lit(BUCKETS)).cast("int")


def content_id(df: DataFrame) -> str:
    """An id of a frame's rows, whatever their order: sums of two hashes, and the count."""
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in sorted(df.columns)]
    one = F.xxhash64(*texts)
    r = df.agg(F.sum(one.cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(one, *texts).cast("decimal(38,0)")).alias("b"),
               F.count(F.lit(1)).alias("n")).first()
    return hashlib.sha256(f"{r.a}/{r.b}/{r.n}".encode()).hexdigest()[:32]


def commits(spark: SparkSession, path: str) -> dict[str, dict]:
    """The committed batches that nothing replaces, by id, in a fixed order."""
    try:
        found = spark.read.schema(COMMIT).parquet(f"{path}/commits").collect()   # one small row for each batch
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return {}
        raise
    gone = {b for r in found for b in r.replaces}
    return {r.batch_id: r.asDict() for r in sorted(found, key=lambda r: r.batch_id) if r.batch_id not in gone}


def _committed(spark: SparkSession, path: str, batch: str) -> bool:
    try:
        return spark.read.schema(COMMIT).parquet(f"{path}/commits/batch={batch}").count() > 0
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return False
        raise


def write_log(df: DataFrame, path: str, mode: str = "append", keys: list[str] | None = None, batch: str | None = None,
              replaces: list[str] | None = None, bucketed: bool = True) -> int:
    """Append a fuel or odometer log as one committed batch, or overwrite the table with it.

    Returns the rows written: 0 where the batch was committed before."""
    keys = [KEY] if keys is None else list(keys)
    spark = df.sparkSession
    batch = batch or content_id(df)
    if _committed(spark, path, batch):
        return 0
    if mode == "overwrite":
        replaces = list(commits(spark, path))
    folder = f"{path}/data/batch={batch}"
    out = df.withColumns({MONTH_COL: F.date_format(TS, "yyyy-MM"), BUCKET_COL: _bucket([F.col(k) for k in keys]) if keys and bucketed else F.lit(ANY)})
    # ranges of (month, bucket, keys, time): a vehicle with many rows in a month is split by time
    order = [MONTH_COL, BUCKET_COL, *keys, TS]
    writer = out.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(MONTH_COL, BUCKET_COL)
    for k in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
    writer.parquet(folder)
    rows = spark.read.schema(df.schema).parquet(folder).count()
    _commit(spark, path, batch, rows, list(replaces or []), df.schema)
    return rows


def _commit(spark: SparkSession, path: str, batch: str, rows: int, replaces: list[str], schema: StructType) -> None:
    """One row in one file: it is there or not."""
    record = [(batch, rows, replaces, json.dumps(schema.jsonValue()))]
    spark.createDataFrame(record, COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={batch}")


def read_log(spark: SparkSession, path: str, period: Period | None = None, vehicle: int | None = None,
             schema: StructType | None = None) -> DataFrame:
    """Read a stored log's committed batches; months outside ``period`` and buckets without
    ``vehicle`` are pruned (P5, P6).

    ``schema`` (``FUEL_SCHEMA`` or ``ODO_SCHEMA``) fixes the columns: those that some files
    lack are null there, others are left out.  Without it they are those of the last batch
    by id."""
    active = commits(spark, path)
    if schema is None:
        if not active:
            raise FileNotFoundError(f"no committed log in {path}")
        schema = StructType.fromJson(json.loads(list(active.values())[-1]["schema_json"]))
    folders = [f"{path}/data/batch={b}" for b, record in active.items() if record["rows"]]
    if not folders:
        return spark.createDataFrame([], schema)
    stored = StructType([*schema.fields, StructField(MONTH_COL, StringType()), StructField(BUCKET_COL, IntegerType())])
    df = spark.read.schema(stored).option("basePath", f"{path}/data").parquet(*folders)
    if period is not None:
        df = df.filter(F.col(MONTH_COL).between(period.start.strftime("%Y-%m"), period.end.strftime("%Y-%m")))
        df = df.filter(period.contains(TS))
    if vehicle is not None:
        df = df.filter((F.col(BUCKET_COL).isin(ANY, _bucket([F.lit(vehicle)]))) & (F.col(KEY) == vehicle))
    return df.select(*schema.names)


def compact_log(spark: SparkSession, path: str, keys: list[str] | None = None) -> int:
    """Write all committed batches as one, so that many small appends become few files by
    month and bucket; readers see the old ones up to its commit.  Returns its rows."""
    active = commits(spark, path)
    if len(active) < 2:
        return 0
    name = "compact-" + hashlib.sha256("/".join(active).encode()).hexdigest()[:24]
    return write_log(read_log(spark, path), path, "append", keys, name, list(active))


def import_if_empty(spark: SparkSession, incoming_fuel: DataFrame, incoming_odo: DataFrame,
                    fuel_path: str, odo_path: str, keys: list[str] | None = None) -> tuple[int, int]:
    """Idempotent backfill: append incoming rows only for vehicles with no committed rows yet
    in that log; the two logs are tested independently (S5).  Returns the imported counts.

    Each log is committed at once: a run that is killed leaves no vehicle half imported, and
    the next one imports all that is missing."""
    keys = [KEY] if keys is None else list(keys)
    checkpoint_dir(spark)
    counts = []
    for incoming, path in ((incoming_fuel, fuel_path), (incoming_odo, odo_path)):
        todo = import_missing(incoming, read_log(spark, path), keys) if commits(spark, path) else incoming
        # fixed once: the id, the count and the write see the same rows of one state of the table
        staged = todo.checkpoint(eager=True)
        counts.append(write_log(staged, path, "append", keys) if staged.head(1) else 0)
    return counts[0], counts[1]


def append_entries(spark: SparkSession, entries: DataFrame, fuel_path: str, keys: list[str] | None = None,
                   clean: bool = False, batch: str | None = None) -> DataFrame:
    """Validate form entries (V18; ``clean`` runs the decimal clean-up V19 first) and append
    the accepted ones; returns the rejected rows as entered with their field errors (S6).

    Both come from one batch that is read and judged once, so they are parts of the same
    rows.  The batch is known by ``batch`` or by its content: appending it again, after a
    failure or by mistake, stores nothing twice.  Entries without ``row_num`` are stored
    without one."""
    keys = [KEY] if keys is None else list(keys)
    checkpoint_dir(spark)
    judged = rules.judge_entries(entries, clean=clean).checkpoint(eager=True)
    accepted = rules.accepted_entries(judged, keys).drop("warnings")
    missing = {f.name: F.lit(None).cast(f.dataType) for f in FUEL_SCHEMA if f.name not in accepted.columns}
    name = batch or "entries-" + content_id(judged.select(*entries.columns))
    write_log(accepted.withColumns(missing).select(*FUEL_SCHEMA.names), fuel_path, "append", keys, name, bucketed=False)
    return rules.rejected_entries(judged, entries.columns)


def write_report(sections: dict[str, DataFrame], out_dir: str, period: Period, fmt: str = "parquet") -> dict[str, str]:
    """Write every report section as its own dataset under ``period=<start>_to_<end>``."""
    tag = f"period={period.display_start}_to_{period.display_end}"
    written = {}
    for name, df in sections.items():
        path = f"{out_dir.rstrip('/')}/{name}/{tag}"
        df.write.mode("overwrite").format(fmt).save(path)
        written[name] = path
    return written
