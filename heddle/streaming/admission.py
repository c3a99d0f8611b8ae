"""Stateful admission of requests: nonces and idempotency keys are keyed state that expires.

Each nonce and each key is a value in the stream's state store (RocksDB, on the executors,
kept by the checkpoint), with a time to live. A micro-batch looks up the keys that it has and
nothing else, however long the stream has been running; state of an old key goes by itself.
A micro-batch that is run again starts from the state before it, so receipts stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from heddle.sources import batches as B

#: Seconds that a nonce and an idempotency key are remembered. A nonce need not outlive the window of its request's time on both sides.
NONCE_TTL, KEY_TTL = 2 * B.TIME_WINDOW, 30 * 86400
#: Settings that stateful admission needs: state in RocksDB, and no micro-batches without data, which expiry would ask for without end.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


class FirstUse(StatefulProcessor):
    """Rows with first (nothing had their key before) and held (the digest of the row that was first).

    Rows of a key come by (arrived, file, digest). Rows that are not live pass by the state.
    """

    def __init__(self, seconds: int):
        self.ttl = 1000 * seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("first", "digest string", self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.state.get() if self.state.exists() else None
        held = held[0] if held else None
        for r in sorted(rows, key=lambda r: (r.arrived, r.file, r.digest)):
            first = r.live and held is None
            if first:
                held = r.digest
                self.state.update((held,))
            yield Row(**r.asDict(), first=first, held=held if r.live else None)

    def close(self) -> None:
        pass


def first_use(stream: DataFrame, key: Column, live: Column, digest: Column, seconds: int) -> DataFrame:
    """stream with first and held (FirstUse); rows whose live isn't true never wait for one another."""
    on = F.coalesce(live, F.lit(False))
    alone = F.concat_ws(":", F.lit("!"), F.sha2(F.concat_ws(":", "file", "body"), 256))
    rows = stream.withColumns({"digest": F.coalesce(digest, F.lit("")), "live": on, "__key": F.when(on, key).otherwise(alone)})
    schema = T.StructType([*rows.schema, T.StructField("first", T.BooleanType()), T.StructField("held", T.StringType())])
    out = rows.groupBy("__key").transformWithState(FirstUse(seconds), schema, "Append", "ProcessingTime")
    return out.drop("__key", "live", "digest")


def admitted(stream: DataFrame, secret: bytes | None = None, allowed: list[str] | None = None, nonce_ttl: int = NONCE_TTL, key_ttl: int = KEY_TTL) -> DataFrame:
    """Requests with outcome: why one is refused, or its receipt (new, duplicate, conflict); and errors.

    In this order: headers, time, signature and nonce (with a secret), the batch's contract,
    the policy of its sources, its idempotency key. A nonce is used up by a sound signature,
    whatever becomes of the body; a key only by a batch that is taken in.
    """
    rows = stream
    if secret is None:
        rows = rows.withColumn("refused", F.lit(None).cast("string"))
    else:
        rows = B.authenticated(rows, secret)
        rows = first_use(rows, F.col("nonce"), F.col("refused").isNull(), F.col("nonce"), nonce_ttl)
        rows = rows.withColumn("refused", F.when(F.col("refused").isNull() & ~F.col("first"), "replayed_nonce").otherwise(F.col("refused"))).drop("first", "held")
    rows = B.checked(rows).withColumn("__b", F.from_json("body", B.BATCH))
    policy = B.source_errors(F.col("__b.sources"), allowed)
    rows = rows.withColumn("errors", F.when(F.size("errors") > 0, F.col("errors")).otherwise(policy))
    reason = F.when(F.col("refused").isNotNull(), F.col("refused")).when(F.size("errors") > 0, F.when(F.size(policy) > 0, "source_policy_rejected").otherwise("invalid_schema"))
    rows = rows.withColumns({"refused": reason, "idempotency_key": F.concat_ws(":", "__b.crawl_run_id", "__b.batch_number"), "body_sha256": F.sha2("body", 256)}).drop("__b")
    rows = first_use(rows, F.col("idempotency_key"), F.col("refused").isNull(), F.col("body_sha256"), key_ttl)
    receipt = F.when(F.col("first"), "new").when(F.col("held") == F.col("body_sha256"), "duplicate").otherwise("conflict")
    return rows.withColumn("outcome", F.coalesce("refused", receipt)).drop("first", "held", "refused")
