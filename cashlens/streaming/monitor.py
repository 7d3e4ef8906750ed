"""Incremental monitor: arriving movements become daily partials, and alerts are derived anew for touched keys only.

Every micro-batch writes partials of its own movements under its batch number, so a repeated batch replaces itself; a
day's partials of all batches are summed on read. No movement is too late, and no state is kept. The alerts of a batch
cover the keys it touched, over their whole series; a key's newest batch is what holds.

Both are kept as folders that are merged in tiers, ``fan_out`` into one: a movement is rewritten once a tier, and after n
batches at most some 2 x fan_out folders a tier are left.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cashlens.config import PanelConfig
from cashlens.functions.exprs import clip
from cashlens.operators.health import add_health


class TieredLog:
    """Folders ``b<first>-<last>`` under ``path``, each for a run of batches; a folder inside another one's run is merged.

    A folder counts once it is complete. Merged folders are deleted one merge later, so that a reader who listed them
    before has them still.
    """

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], fan_out: int = 8):
        self.spark, self.path, self.merge, self.fan_out = spark, path, merge, fan_out
        self._root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def folders(self) -> list[tuple[int, int]]:
        """(first, last) batch of the complete folders."""
        found = self._fs.globStatus(self._root.suffix("/b*/_SUCCESS")) or []
        return sorted(tuple(map(int, f.getPath().getParent().getName()[1:].split("-"))) for f in found)

    def live(self) -> list[tuple[int, int]]:
        have = self.folders()
        return [f for f in have if not any(g != f and g[0] <= f[0] and f[1] <= g[1] for g in have)]

    def _name(self, folder: tuple[int, int]) -> str:
        return f"{self.path}/b{folder[0]}-{folder[1]}"

    def read(self, only: list[tuple[int, int]] | None = None) -> DataFrame | None:
        """What is live; None before the first batch."""
        live = self.live() if only is None else only
        return self.spark.read.parquet(*map(self._name, live)) if live else None

    def write(self, df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(self._name((epoch, epoch)))

    def compact(self, epoch: int) -> None:
        """Merge what is full before batch ``epoch``, whose predecessors are committed and won't be written again."""
        span = self.fan_out
        while epoch and epoch % span == 0:
            whole, before = (epoch - span, epoch - 1), (epoch - 2 * span, epoch - span - 1)
            have = self.folders()
            parts = [f for f in self.live() if whole[0] <= f[0] and f[1] <= whole[1]]
            if whole not in have and parts:
                self.merge(self.read(parts)).write.mode("overwrite").parquet(self._name(whole))
            for old in have if before in have else ():
                if old != before and before[0] <= old[0] and old[1] <= before[1]:
                    self._fs.delete(self._root.suffix(f"/b{old[0]}-{old[1]}"), True)
            span *= self.fan_out


def daily_rollup(batch: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Per key and day: movements and sum of one batch."""
    return (batch.groupBy(F.window(ts, "1 day").alias("w"), key)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
            .select(key, F.col("w.start").alias("day"), "n", "total"))


def summed(parts: DataFrame, key: str) -> DataFrame:
    return parts.groupBy(key, "day").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def newest(rows: DataFrame, key: str) -> DataFrame:
    """Of every key the rows of its newest batch (one number a key is aggregated and joined back)."""
    return rows.join(rows.groupBy(key).agg(F.max("epoch").alias("epoch")), [key, "epoch"], "left_semi")


def partials(spark: SparkSession, out: str, key: str, fan_out: int = 8) -> TieredLog:
    return TieredLog(spark, f"{out}/days", lambda df: summed(df, key), fan_out)


def alert_log(spark: SparkSession, out: str, key: str, fan_out: int = 8) -> TieredLog:
    return TieredLog(spark, f"{out}/alerts", lambda df: newest(df, key), fan_out)


def run(stream: DataFrame, key: str, ts: str, value: str, out: str, checkpoint: str,
        derive: Callable[[DataFrame], DataFrame] | None = None, fan_out: int = 8) -> None:
    """Process everything available and stop; call again when more files have arrived.

    ``derive`` turns the months of some keys into their alert rows; it sees the touched keys only.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        days, alerts = partials(spark, out, key, fan_out), alert_log(spark, out, key, fan_out)
        days.compact(epoch)
        days.write(daily_rollup(batch, key, ts, value), epoch)
        if derive:
            alerts.compact(epoch)
            ids = days.read([(epoch, epoch)]).select(key).distinct()
            mine = summed(days.read().join(ids, key, "left_semi"), key)
            alerts.write(derive(monthly(mine, key)).withColumn("epoch", F.lit(epoch).cast("long")), epoch)
    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def daily(spark: SparkSession, out: str, key: str) -> DataFrame:
    """Every (key, day), over all batches."""
    return summed(partials(spark, out, key).read(), key)


def current_alerts(spark: SparkSession, out: str, key: str) -> DataFrame:
    """Every key's newest alert rows, with the batch (``epoch``) that derived them."""
    return newest(alert_log(spark, out, key).read(), key)


def monthly(days: DataFrame, key: str) -> DataFrame:
    return days.groupBy(key, F.date_format("day", "yyyy-MM").alias("T")).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("active_days"))


def activity_alerts(months: DataFrame, key: str, cfg: PanelConfig) -> DataFrame:
    """Health and alerts from activity: the risk grows as a month's movements fall below the mean of the three before."""
    o = W.partitionBy(key).orderBy("T")
    usual = F.avg("n").over(o.rowsBetween(-3, -1))
    p = F.round(clip(0.2 + 0.6 * (1 - F.coalesce(F.col("n") / usual, F.lit(1.0))), 0, 1), 6)
    rows = months.select(F.col(key).alias("company_id"), "T", "n", p.alias("score"), F.row_number().over(o).alias("t_idx"))
    return add_health(rows, "score", cfg).withColumnRenamed("company_id", key)
