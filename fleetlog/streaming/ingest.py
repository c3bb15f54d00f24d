"""Structured Streaming: ingestion with quarantine (ST1) and running
month-to-date totals per vehicle (ST2).

ST1 applies the entry rules (or the CSV row rules) to every micro-batch and
writes accepted rows and rejected raw rows to two tables.  Each batch goes to
its own ``epoch=<id>`` folder written with overwrite, so a retried batch
replaces its earlier attempt instead of duplicating it.

ST2 keeps no state: each micro-batch writes its own sums per (key, month), and
the current value is the sum over epochs.  So a row counts whenever it arrives,
in any order and however late; no watermark drops it.

Epochs are compacted in tiers, as digits of a number: of every ``FAN`` units of a tier the
last epoch's batch writes one unit of the next tier with their sums.  Which units hold
the first n epochs follows from n alone, so a reader needs one number, and reads at
most ``FAN - 1`` units of each tier, however many epochs there were.  The number
is written last, into two slots by turns, so one of them is whole at any time;
a batch that is repeated after a failure, also one in the middle of a merge,
writes the same units again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlog.functions.calendar import month_start
from fleetlog.functions.text import round6
from fleetlog.operators import rules
from fleetlog.schema import KEY, ROW, TS
from fleetlog.session import checkpoint_dir, scratch_path
from fleetlog.sources import fixtures as fx


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """Stream the Parquet files of one table from a folder (schema taken from the batch read)."""
    schema = fx.table(spark, sf_dir, name).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(sf_dir)


def ingest_fuel(raw: DataFrame, accepted_path: str, issues_path: str, checkpoint: str,
                keys: list[str] | None = None, available_now: bool = True,
                config: rules.RuleConfig = rules.RuleConfig()) -> StreamingQuery:
    """Validate a stream of raw fuel rows; accepted rows and issues go to two Parquet tables (ST1)."""
    keys = list(keys or [])

    def write_batch(batch: DataFrame, epoch: int) -> None:
        parsed, issues = rules.validate_fuel_rows(batch, keys, config, store=True)  # read and parsed once for both tables
        rules.fuel_good_rows(parsed, keys).write.mode("overwrite").parquet(f"{accepted_path}/epoch={epoch}")
        issues.write.mode("overwrite").parquet(f"{issues_path}/epoch={epoch}")

    checkpoint_dir(raw.sparkSession)
    return _started(raw.writeStream.foreachBatch(write_batch), checkpoint, available_now)


def _started(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def ingest_entries(entries: DataFrame, accepted_path: str, rejected_path: str, checkpoint: str,
                   keys: list[str] | None = None, available_now: bool = True, clean: bool = False,
                   config: rules.RuleConfig = rules.RuleConfig()) -> StreamingQuery:
    """Validate a stream of form entries (V18, with ``clean`` V19 first); accepted rows and
    rejected rows as entered, with their field errors, go to two Parquet tables (ST1)."""
    keys = [KEY] if keys is None else list(keys)

    def write_batch(batch: DataFrame, epoch: int) -> None:
        # both tables come from one judged batch, read and parsed once
        judged = rules.judge_entries(batch, config, clean).checkpoint(eager=True)
        rules.accepted_entries(judged, keys, config).write.mode("overwrite").parquet(f"{accepted_path}/epoch={epoch}")
        rules.rejected_entries(judged, batch.columns).write.mode("overwrite").parquet(f"{rejected_path}/epoch={epoch}")

    checkpoint_dir(entries.sparkSession)
    return _started(entries.writeStream.foreachBatch(write_batch), checkpoint, available_now)


def month_sums(fuel: DataFrame, keys: list[str]) -> DataFrame:
    """Litres, EUR and entries per key and calendar month, as exact decimals to add up further."""
    def total(c: str) -> Column:
        return F.sum(F.col(c).cast("decimal(28,9)")).cast("decimal(38,9)").alias(f"month_{c}")
    return fuel.groupBy(*keys, month_start(TS).alias("month")).agg(total("liters"), total("amount_eur"),
                                                                  F.count(F.lit(1)).alias("month_entries"))


FAN = 16


def _unit(out_path: str, tier: int, last: int) -> str:
    return f"{out_path}/tier={tier}/last={last}"


def units(n: int, fan: int = FAN) -> list[tuple[int, int]]:
    """(tier, last epoch) of the units that hold the first ``n`` epochs."""
    tier = 0
    while fan ** (tier + 1) <= n:
        tier += 1
    out, done = [], 0
    for t in range(tier, -1, -1):
        for _ in range((n - done) // fan ** t):
            done += fan ** t
            out.append((t, done - 1))
    return out


def _added_up(sums: DataFrame, keys: list[str]) -> DataFrame:
    return sums.groupBy(*keys, "month").agg(
        *[F.sum(c).cast("decimal(38,9)").alias(c) for c in ("month_liters", "month_amount_eur")], F.sum("month_entries").alias("month_entries"))


def write_epoch(sums: DataFrame, out_path: str, epoch: int, keys: list[str], fan: int = FAN) -> None:
    """Write the sums of an epoch, the merges that it completes, and then its number."""
    spark = sums.sparkSession
    sums.write.mode("overwrite").parquet(_unit(out_path, 0, epoch))
    tier = 1
    while (epoch + 1) % fan ** tier == 0:
        parts = [_unit(out_path, tier - 1, epoch - i * fan ** (tier - 1)) for i in range(fan)]
        _added_up(spark.read.parquet(*parts), keys).write.mode("overwrite").parquet(_unit(out_path, tier, epoch))
        tier += 1
    spark.range(1).select(F.lit(epoch).cast("long").alias("epoch")).coalesce(1).write.mode("overwrite").parquet(f"{out_path}/head/slot={epoch % 2}")


def run_month_to_date(fuel: DataFrame, out_path: str, checkpoint: str, keys: list[str] | None = None,
                      available_now: bool = True, fan: int = FAN) -> StreamingQuery:
    """Write each batch's sums per (key, month) as a unit and merge full tiers (ST2)."""
    keys = [KEY] if keys is None else list(keys)

    def write_batch(batch: DataFrame, epoch: int) -> None:
        write_epoch(month_sums(batch, keys), out_path, epoch, keys, fan)

    return _started(fuel.writeStream.foreachBatch(write_batch), checkpoint, available_now)


def latest_month_to_date(spark: SparkSession, out_path: str, keys: list[str] | None = None, fan: int = FAN) -> DataFrame:
    """Current month totals: the sum over the units of all finished epochs."""
    keys = [KEY] if keys is None else list(keys)
    last = spark.read.parquet(f"{out_path}/head").agg(F.max("epoch")).first()[0]
    read = [_unit(out_path, t, e) for t, e in units(last + 1, fan)]
    return _added_up(spark.read.parquet(*read), keys).select(
        *keys, "month", F.col("month_liters").cast("double").alias("month_liters"),
        F.col("month_amount_eur").cast("double").alias("month_eur"), "month_entries")


def _fuel_from_events(events: DataFrame) -> DataFrame:
    return (events.filter(F.col("event_type") == "purchase")
            .select(F.col("user_id").alias(KEY), F.col("ts").alias(TS), F.col("event_id").alias(ROW),
                    F.col("value").alias("amount_eur"),
                    (F.get_json_object("props", "$.k").cast("double") + 1).alias("liters")))


def stream_month_to_date_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: purchases of ``events`` streamed into running month totals."""
    base = scratch_path(spark, "stream-mtd")
    q = run_month_to_date(_fuel_from_events(table_stream(spark, sf_dir, "events")), f"{base}/out", f"{base}/ck")
    q.awaitTermination()
    return latest_month_to_date(spark, f"{base}/out").select(
        KEY, "month", "month_entries", round6("month_liters").alias("month_liters"), round6("month_eur").alias("month_eur"))


def stream_ingest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: ``fx_dirty`` rows streamed through the row rules; returns the accepted rows."""
    base = scratch_path(spark, "stream-ingest")
    raw = fx.dirty_rows(table_stream(spark, sf_dir, "orders"))
    q = ingest_fuel(raw, f"{base}/accepted", f"{base}/issues", f"{base}/ck")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/accepted").select(ROW, TS, "amount_eur", "liters", "fuel_type",
                                                         "is_full_tank", "station_name", "city", "country")


def stream_entries_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: ``fx_dirty`` rows streamed through the entry rules; every row with its verdict."""
    base = scratch_path(spark, "stream-entries")
    raw = fx.dirty_rows(table_stream(spark, sf_dir, "orders")).withColumnRenamed("datetime", "entry_date")
    ingest_entries(raw, f"{base}/accepted", f"{base}/rejected", f"{base}/ck").awaitTermination()
    accepted = spark.read.parquet(f"{base}/accepted").select(KEY, ROW, F.lit("").alias("error_fields"), F.lit(None).cast("string").alias("entered"))
    fields = F.array_join(F.array_sort(F.map_keys("errors")), ",")
    return accepted.unionByName(spark.read.parquet(f"{base}/rejected").select(
        KEY, ROW, fields.alias("error_fields"), F.col("liters").alias("entered")))
