"""Streaming forms: review incoming pairs, failure rates over event-time windows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assaykit.functions.stats import rate
from assaykit.operators.generation import pair_text
from assaykit.operators.hooks import Completer, complete
from assaykit.operators.labels import label_pairs
from assaykit.operators.validation import validate_pairs
from assaykit.schemas import PAIR, PAIR_FAILURES


JUDGEMENT = "hallucination_score int, awkward_language_score int, quality_score int, fit_assessment string, recommendations array<string>"


def judged(template: str, judge: Completer) -> Column:
    """A judge's scores of a pair (struct), null where the call failed, the answer is no such JSON or a score is out of range."""
    answer = F.from_json(complete(pair_text(template), judge)["item"], JUDGEMENT)
    sound = F.lit(True)
    for score, high in (("hallucination_score", 5), ("awkward_language_score", 5), ("quality_score", 10)):
        sound = sound & F.coalesce(answer[score].between(0, high), F.lit(False))
    return F.when(sound, answer)


def review(pairs: DataFrame, as_of: str, judge: Completer | None = None, template: str = "") -> DataFrame:
    """Labels, validation outcome and error count of each pair; stateless, the same for batch and stream.

    With a ``judge`` a column ``judge`` holds its scores of the pair as ``template`` shows it; without, no such column exists.
    """
    checked = validate_pairs(pairs, as_of)
    more = [] if judge is None else [judged(template, judge).alias("judge")]
    return label_pairs(checked, as_of, keep=["is_valid", "error_count", *more]).withColumnsRenamed(
        {"is_valid": "validation_passed", "error_count": "validation_error_count"})


def read_pair_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """JSON-lines pairs arriving as files."""
    reader = spark.readStream.schema(PAIR)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def with_default_metadata(requests: DataFrame, created_at: str) -> DataFrame:
    """A review request (resume, job) as a pair: fit level Partial, style formal, stable id."""
    body = F.to_json(F.struct("resume", "job"))
    return requests.withColumn("metadata", F.struct(
        F.sha2(body, 256).substr(1, 32).alias("pair_id"), F.lit(created_at).alias("created_at"),
        F.lit("Partial").alias("fit_level"), F.lit("formal").alias("writing_style"),
        F.lit(0).alias("correction_attempts"), F.lit(True).alias("passed_validation"),
        F.lit(0).alias("validation_error_count")))


def to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream to Parquet until all input present now is done (exactly once through the checkpoint)."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run :func:`to_files` to its end and read the result back."""
    to_files(stream, path, checkpoint).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def window_rates(events: DataFrame, time: str, flags: list[str] = PAIR_FAILURES, keys: list[str] | None = None,
                 window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Tumbling windows with the count and the rate of each flag; rows later than the watermark are dropped.

    State is one row of sums per open window and key, combined before the shuffle.
    """
    sums = [F.sum(F.col(f).cast("long")).alias(f"n_{f}") for f in flags]
    grouped = events.withWatermark(time, delay).groupBy(F.window(time, window), *(keys or []))
    return grouped.agg(F.count("*").alias("n"), *sums).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(keys or []), "n",
        *[rate(F.col(f"n_{f}"), F.col("n")).alias(f"rate_{f}") for f in flags])


class LatestRates:
    """A small table of the latest closed windows, fed by a stream and read by whoever asks for the current rates.

    Every micro-batch writes one new version: the windows of the version before, with those of the batch merged in. A version is a
    folder named after the batch, and the last complete one counts. A batch that the stream repeats after a failure finds its
    folder complete and does nothing, or writes it anew from the version before it: each window is merged exactly once. Only
    the last ``keep`` windows stay, so a version is small however long the stream has run; rows that came after the watermark are
    counted per version from the stream's own progress (see :func:`late_rows`).
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None, keep: int = 10_000):
        self.spark, self.path, self.keys, self.keep = spark, path.rstrip("/"), keys or [], keep
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        if not self.fs.exists(path(self.path)):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(path(self.path))]
        done = [n for n in names if n.startswith("batch-") and self.fs.exists(path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n.removeprefix("batch-")) for n in done)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of closed windows; repeating a batch changes nothing."""
        done = self._versions()
        if batch_id in done or (done and batch_id < done[-1]):
            return
        key = ["window_start", "window_end", *self.keys]
        rows = batch.withColumn("_batch", F.lit(batch_id).cast("long"))
        if done:
            before = self.spark.read.schema(rows.schema).parquet(f"{self.path}/batch-{done[-1]}")
            rows = before.unionByName(rows)
        rest = [c for c in rows.columns if c not in key]
        last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col("_batch")).alias("_row")).select(*key, "_row.*")
        newest = last.orderBy(F.desc("window_start"), *self.keys).limit(self.keep)
        newest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch-{batch_id}")
        for old in done[:-1]:  # the version before stays for readers that have opened it
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch-{old}"), True)

    def run(self, windows: DataFrame, checkpoint: str) -> StreamingQuery:
        """Feed the table from a stream of :func:`window_rates` until all input present now is done."""
        return (
            windows.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start()
        )

    def read(self) -> DataFrame:
        """The windows of the last version; an error where nothing has been stored yet."""
        done = self._versions()
        if not done:
            raise LookupError(f"no rates found in {self.path}: run the stream first")
        return self.spark.read.parquet(f"{self.path}/batch-{done[-1]}").drop("_batch")


def late_rows(query: StreamingQuery) -> int:
    """Rows (pre-aggregated per task and window) that a stream has dropped because they came after the watermark."""
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)


def latest_rates(metrics: DataFrame | str | None, spark: SparkSession | None = None) -> DataFrame:
    """Batch form: the stored report of the last run, as a table or the path of one; an error when there is none yet."""
    if isinstance(metrics, str):
        session = spark or SparkSession.getActiveSession()
        try:
            return session.read.parquet(metrics).where(F.col("section").isin("failure_rates", "overall"))
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
                raise
            metrics = None
    if metrics is None:
        raise LookupError("no summary found: run the analysis first")
    return metrics.where(F.col("section").isin("failure_rates", "overall"))
