"""Sliding-window admission: at most `limit` accepted requests per principal in any trailing window."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

# Default budget.
MAX_REQUESTS = 20
WINDOW_SECONDS = 3600


def _cells(keyed: DataFrame, limit: int) -> DataFrame:
    """Request counts per (principal, window-wide cell), with the stretch of busy cells each belongs to.

    A trailing window touches at most two neighbouring cells. Where those hold no more than `limit`
    requests together, every request of the later cell is accepted, whatever happened before.
    """
    counts = keyed.groupBy("principal", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("principal").orderBy("_cell")
    before = F.when(F.lag("_cell").over(w) == F.col("_cell") - 1, F.lag("_n").over(w)).otherwise(F.lit(0))
    busy = counts.withColumn("_busy", F.col("_n") + before > limit)
    place = F.row_number().over(Window.partitionBy("principal", "_busy").orderBy("_cell"))
    stretch = busy.withColumn("_stretch", F.when(F.col("_busy"), F.col("_cell") - place))
    leads = (F.lead("_cell").over(w) == F.col("_cell") + 1) & ~F.col("_busy")
    return stretch.withColumn("_leads_to", F.when(leads, F.lead("_stretch").over(w))).drop("_n")


def admit(
    requests: DataFrame, limit: int = MAX_REQUESTS, window_seconds: int = WINDOW_SECONDS
) -> DataFrame:
    """Adds `accepted` to requests (principal, arrival, at); only accepted ones fill the window.

    Calm cells are decided in the JVM. Each stretch of busy cells is decided on its own, in order, with the
    requests of the calm cell before it (all accepted) as its starting state: sorted Arrow batches stream
    through a helper that keeps `limit` times, so a stretch is never held in memory. The chain of
    decisions inside one stretch is sequential by definition.
    """
    width = window_seconds * 1_000_000
    keyed = requests.withColumn("_us", F.unix_micros("at")).withColumn("_cell", F.expr(f"_us div {width}"))
    placed = keyed.join(_cells(keyed, limit), ["principal", "_cell"])
    columns = requests.columns
    calm = placed.where(~F.col("_busy")).select(*columns, F.lit(True).alias("accepted"))

    own = placed.where("_busy").select(*columns, "_us", "_stretch", F.lit(True).alias("_own"))
    context = placed.where(F.col("_leads_to").isNotNull()).select(
        *columns, "_us", F.col("_leads_to").alias("_stretch"), F.lit(False).alias("_own")
    )
    ordered = (
        own.unionByName(context)
        .repartition("principal", "_stretch")
        .sortWithinPartitions("principal", "_stretch", "_us", "arrival")
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, taken = None, deque()
        for batch in batches:
            flags = []
            for who, stretch, us in zip(batch["principal"], batch["_stretch"], batch["_us"], strict=True):
                if (who, stretch) != current:
                    current, taken = (who, stretch), deque()
                while taken and us - taken[0] >= width:
                    taken.popleft()
                ok = len(taken) < limit
                if ok:
                    taken.append(us)
                flags.append(ok)
            done = batch.assign(accepted=flags)
            yield done[done["_own"]].drop(columns=["_us", "_stretch", "_own"])

    return calm.unionByName(ordered.mapInPandas(decide, f"{fields}, accepted boolean"))
