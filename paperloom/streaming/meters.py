"""Metrics of running streams: observed in each micro-batch, added up by a listener, read as text."""

from __future__ import annotations

from collections import Counter
from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from paperloom.operators.metrics import lines


def measured(stream: DataFrame, metric: str, value: str, bounds) -> DataFrame:
    """stream as it is, with how many values there are in each micro-batch, their sum, and how many are at most each bound."""
    held = F.col(value).isNotNull()
    return stream.observe(metric, F.count_if(held).alias("count"), F.coalesce(F.sum(value), F.lit(0)).cast("double").alias("sum"), *(F.count_if(F.col(value) <= F.lit(float(b))).alias(f"b{i}") for i, b in enumerate(bounds)))


def counted_once(events: DataFrame, key: str, label: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(label, total): how many events there are of each label; one that is sent again within `late` counts once."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]).groupBy(label).agg(F.count("*").alias("total"))


class Meters(StreamingQueryListener):
    """Adds up what measured() has observed; metrics(name -> bounds) are those that are looked for.

    A micro-batch counts once, by query and number, also if its progress is reported again.
    """

    def __init__(self, metrics: dict[str, tuple]):
        self.metrics, self.seen, self.lock = metrics, set(), Lock()
        self.totals: dict[str, Counter] = {name: Counter() for name in metrics}

    def onQueryStarted(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.lock:
            for name, row in p.observedMetrics.items():
                if name in self.metrics and (p.id, p.batchId, name) not in self.seen:
                    self.seen.add((p.id, p.batchId, name))
                    self.totals[name].update({k: v for k, v in row.asDict().items() if v})

    def text(self, name: str, help_text: str) -> str:
        """Cumulative buckets, sum and count in the text format of a scrape."""
        with self.lock:
            total = self.totals[name]
            pairs = [*((float(b), total[f"b{i}"]) for i, b in enumerate(self.metrics[name])), (float("inf"), total["count"])]
            return "\n".join(lines(name, help_text, [({}, pairs, float(total["sum"]), total["count"])]))
