"""Structured Streaming: running summaries of score files, windowed event counts, accumulate-until-full batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORES = "attack string, idx bigint, id bigint, score double"


def read_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the JSON-lines score files in ``folder``; malformed lines come out as nulls and are dropped."""
    return spark.readStream.schema(SCORES).option("mode", "PERMISSIVE").json(folder).where("score is not null")


def running_summary(scores: DataFrame) -> DataFrame:
    """Count, mean, least and greatest score per attack, over all files so far."""
    return scores.groupBy("attack").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.min("score").alias("lo"), F.max("score").alias("hi"))


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events per window and type with a watermark; ``ts`` may be without zone. Rows later than ``late`` are dropped."""
    e = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late)
    return e.groupBy(F.window("t", length, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def filled_batches(groups: DataFrame, size: int) -> DataFrame:
    """``batch_key, batch_no, members``: groups of each key collected until ``size`` are there, then handed on.

    Input ``batch_key string, uid string``. State per key is what is waiting, fewer than ``size`` ids.
    """
    out = T.StructType().add("batch_key", "string").add("batch_no", "long").add("members", T.ArrayType(T.StringType()))
    state = T.StructType().add("no", "long").add("waiting", T.ArrayType(T.StringType()))

    def fill(key, frames, st):
        import pandas as pd

        no, waiting = st.get if st.exists else (0, [])
        waiting = list(waiting)
        for f in frames:
            waiting += f["uid"].tolist()
        while len(waiting) >= size:
            yield pd.DataFrame({"batch_key": [key[0]], "batch_no": [no], "members": [waiting[:size]]})
            no, waiting = no + 1, waiting[size:]
        st.update((no, waiting))

    return groups.groupBy("batch_key").applyInPandasWithState(fill, out, state, "append", "NoTimeout")


def adaptive_coefficients(batches: DataFrame, value: float, target: float, horizon: int) -> DataFrame:
    """``run, step, kl, value``: the penalty coefficient of each run after every batch, moved towards its target.

    Input ``run string, step bigint, kl double, n bigint``, a batch a row; batches that arrive together are taken by
    step, a null or NaN divergence moves nothing. State per run is one number.
    """
    out = T.StructType().add("run", "string").add("step", "long").add("kl", "double").add("value", "double")
    state = T.StructType().add("value", "double")

    def move(key, frames, st):
        import pandas as pd

        kl = AdaptiveKL(st.get[0] if st.exists else value, target, horizon)
        f = pd.concat(list(frames)).sort_values("step")
        moved = [kl.update(x, int(n)) if x == x and x is not None else kl.value for x, n in zip(f["kl"], f["n"])]
        st.update((float(kl.value),))
        yield pd.DataFrame({"run": key[0], "step": f["step"], "kl": f["kl"], "value": moved})

    return batches.groupBy("run").applyInPandasWithState(move, out, state, "append", "NoTimeout")


def run_once(df: DataFrame, name: str, mode: str) -> DataFrame:
    """Drives a stream over all data there is into a table in memory: for tests and small results."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


class AdaptiveKL:
    """The coefficient of a divergence penalty, moved towards a target batch by batch."""

    def __init__(self, value: float, target: float, horizon: int):
        self.value, self.target, self.horizon = value, target, horizon

    def update(self, current: float, steps: int) -> float:
        error = min(max(current / self.target - 1, -0.2), 0.2)
        self.value *= 1 + error * steps / self.horizon
        return self.value
