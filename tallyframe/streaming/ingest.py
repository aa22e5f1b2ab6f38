"""Ingestion as a stream: requests as lines of JSON, validated, taken whole or not at all.

A request is {"request_id": ..., "entries": [{...}, ...]}; a gateway webhook is a request of one
entry, whose key stands in it as idempotency_key. Each micro-batch writes, under its epoch, the
accepted entries, the entries that were not taken with the reason, and a verdict for each
request; the epoch counts once its commit is there, which is written last. A replayed epoch
overwrites itself, so it adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import spread_join
from ..operators import validate

REQUEST = "request_id string, entries array<string>"
TABLES = ("accepted", "rejected", "verdicts")
WITH_BATCH = "another entry of the request"
TOO_MANY = "request size"
NOT_READ = "request format"


def entries_of(lines: DataFrame) -> DataFrame:
    """line, request_id, position, payload: a row an entry, or one without payload where a request has none."""
    request = F.from_json("value", REQUEST)
    read = lines.filter(F.trim("value") != "").select(F.monotonically_increasing_id().alias("line"), F.explode(F.array(request)).alias("r"))
    return read.select("line", "r.request_id", F.posexplode_outer("r.entries").alias("position", "payload"))


def verdicts(checked: DataFrame) -> DataFrame:
    """line, request_id, entries, invalid, accepted: a request is taken if all its entries are valid and they are not too many."""
    there = F.col("payload").isNotNull()
    per = checked.groupBy("line").agg(F.max("request_id").alias("request_id"), F.count_if(there).alias("entries"), F.count_if(there & F.col("reject_reason").isNotNull()).alias("invalid"))
    return per.withColumn("accepted", F.col("entries").between(1, validate.LEDGER_BATCH_MAX) & (F.col("invalid") == 0))


def outcomes(checked: DataFrame, decided: DataFrame) -> DataFrame:
    """checked with reason (null: accepted): an entry's own, or why its request was not taken."""
    said = decided.select("line", F.col("accepted").alias("taken"), (F.col("entries") > validate.LEDGER_BATCH_MAX).alias("too_many"), (F.col("entries") == 0).alias("none"))
    met = spread_join(checked, said, "line", counts=decided.select("line", F.col("entries").alias("n")))
    reason = F.when(F.col("none"), NOT_READ).when(F.col("reject_reason").isNotNull(), F.col("reject_reason")).when(F.col("too_many"), TOO_MANY).when(~F.col("taken"), WITH_BATCH)
    return met.withColumn("reason", reason).drop("reject_reason", "taken", "too_many", "none")


class Intake:
    """The sink of a stream of request lines (value) of one side."""

    def __init__(self, path: str, side: str) -> None:
        self.path, self.side = path.rstrip("/"), side

    def at(self, what: str, epoch: int) -> str:
        return f"{self.path}/{what}/epoch={epoch}"

    def __call__(self, lines: DataFrame, epoch: int) -> None:
        spark = lines.sparkSession
        entries = entries_of(lines)
        checked = validate.validated(entries if self.side == "ledger" else entries.withColumn("idempotency_key", F.get_json_object("payload", "$.idempotency_key")).withColumn("payload", _without_key("payload")), self.side)
        keep = [c for c in ("line", "request_id", "position", "payload", "idempotency_key", "txn_id", "currency", "gateway_ref", "entry_id", "amount_value", "occurred_value", "reject_reason") if c in checked.columns]
        # written once, as lines are numbered where they lie
        checked.select(*keep).write.mode("overwrite").parquet(self.at("checked", epoch))
        checked = spark.read.parquet(self.at("checked", epoch))
        verdicts(checked).write.mode("overwrite").parquet(self.at("verdicts", epoch))
        found = outcomes(checked, spark.read.parquet(self.at("verdicts", epoch)))
        found.filter("reason is null").drop("reason").write.mode("overwrite").parquet(self.at("accepted", epoch))
        found.filter("reason is not null").select("line", "request_id", "position", "payload", "reason").write.mode("overwrite").parquet(self.at("rejected", epoch))
        spark.range(1).write.mode("overwrite").parquet(self.at("commits", epoch))

    def read(self, spark: SparkSession, what: str) -> DataFrame:
        """accepted, rejected or verdicts of all committed epochs."""
        if what not in TABLES:
            raise ValueError(f"{what} is none of {', '.join(TABLES)}")
        done = spark.read.parquet(f"{self.path}/commits").select("epoch").distinct()
        return spark.read.parquet(f"{self.path}/{what}").join(F.broadcast(done), "epoch", "left_semi")


def _without_key(payload: str):
    """The payload less its idempotency_key, which a webhook carries beside its body."""
    fields = F.from_json(payload, "map<string,string>")
    return F.when(F.col(payload).isNotNull(), F.coalesce(F.to_json(F.map_filter(fields, lambda k, _: k != "idempotency_key")), F.col(payload)))


def run_available(spark: SparkSession, source: str, side: str, out: str, checkpoint: str, files_per_batch: int = 1000) -> Intake:
    """Takes in what the folder of request files holds now, and stops."""
    intake = Intake(out, side)
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source)
    lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(intake).trigger(availableNow=True).start().awaitTermination()
    return intake
