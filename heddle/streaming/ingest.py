"""Structured Streaming: idempotent ingest of batches into snapshots, replay and lateness checks, windows, run states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heddle.functions.ids import uuid7
from heddle.operators import resolution as X
from heddle.operators.upsert import classify_ingest, insert_only, upsert
from heddle.sources import batches as B
from heddle.streaming import admission as A

ONCE = "once"
#: Target -> keys and what becomes of a row that is there: column policies, or ONCE, it stays. In the order in which they are written.
TARGETS = {
    "sellers": (["id"], {"first_seen_at": "first", "created_at": "first"}),
    "marketplace_accounts": (["id"], {"seller_id": "first", "first_seen_at": "first"}),
    "seller_aliases": (["id"], {"seller_id": "first", "first_seen_at": "first"}),
    "score_components": (["id"], ONCE),
    "product_links": (["id"], {"seller_id": "first", "first_seen_at": "first"}),
    "contacts": (["id"], {"seller_id": "first", "contact_type": "first", "first_seen_at": "first"}),
    "suppressions": (["id"], {"created_at": "first"}),
    "outreach_states": (["id"], {}),
    "audit_events": (["id"], ONCE),
    "sources": (["id"], {"detected_at": "keep", "first_seen_at": "first"}),
    "crawl_runs": (["id"], {"job_type": "first", "started_at": "first"}),
    "review_queue_items": (["id"], {"reviewed_at": "keep", "reviewed_by": "keep", "created_at": "first"}),
    "source_registry": (["adapter_name"], {}),
    "quota_states": (["quota_name"], {}),
    "feature_flags": (["flag_name"], {}),
    "field_history": (["id"], ONCE),
    "recent_diff_metadata": (["entity_type", "entity_id"], {"id": "first"}),
}
#: A review that is no longer pending keeps its status.
STICKY = {"review_queue_items": {"status": "status <> 'pending'"}}
#: Buckets that a target's rows are in by their keys; versions of a bucket that are kept.
BUCKETS, KEEP = 64, 3


class Store:
    """Tables under one path, in folders by version, the number of the micro-batch that wrote it.

    A target's rows are in buckets by their keys. A version holds only the buckets that its
    micro-batch touched, whole; a bucket's rows are those of the last version that has it.
    A log's versions hold what was added, its rows are those of all. A report is its last
    version. Writing a version again replaces it, so a micro-batch may be run again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        where, fs = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def _versions(self, name: str, before: int | None = None) -> list[int]:
        found = [int(n[1:]) for n in self._names(f"{self.path}/{name}") if n[0] == "v" and "_SUCCESS" in self._names(f"{self.path}/{name}/{n}")]
        return sorted(v for v in found if before is None or v < before)

    def _parts(self, name: str, before: int | None = None) -> dict[int, list[int]]:
        """Bucket -> versions that have it."""
        out: dict[int, list[int]] = {}
        for v in self._versions(name, before):
            for n in self._names(f"{self.path}/{name}/v{v}"):
                if n.startswith("__bucket="):
                    out.setdefault(int(n.split("=")[1]), []).append(v)
        return out

    def _load(self, paths: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*paths) if paths else None

    def read(self, name: str) -> DataFrame | None:
        """A target's rows, or a report's last version."""
        parts = self._parts(name)
        if parts:
            return self._load([f"{self.path}/{name}/v{v[-1]}/__bucket={b}" for b, v in parts.items()])
        return self._load([f"{self.path}/{name}/v{v}" for v in self._versions(name)[-1:]])

    def before(self, name: str, version: int) -> DataFrame | None:
        """A target's rows before a version."""
        parts = self._parts(name, version)
        return self._load([f"{self.path}/{name}/v{v[-1]}/__bucket={b}" for b, v in parts.items()])

    def write(self, name: str, df: DataFrame, version: int) -> None:
        """A report's version, or what is added to a log."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/v{version}")

    def log(self, name: str, before: int | None = None) -> DataFrame | None:
        return self._load([f"{self.path}/{name}/v{v}" for v in self._versions(name, before)])

    def merge(self, name: str, rows: DataFrame, keys: list[str], columns: list[str], combine: Callable[[DataFrame, DataFrame], DataFrame], version: int) -> None:
        """combine(old, rows), of the buckets that rows are in."""
        bucket = F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in rows.select(bucket).distinct().collect()]  # buckets at most
        parts = self._parts(name, version)
        old = self._load([f"{self.path}/{name}/v{parts[b][-1]}/__bucket={b}" for b in touched if b in parts])
        if old is None:
            old = rows.select(*columns).limit(0)
        combine(old.select(*columns), rows).select(*columns, bucket.alias("__bucket")).write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/{name}/v{version}")
        for b in touched:
            for v in parts.get(b, [])[: -KEEP or None]:
                where, fs = self._fs(f"{self.path}/{name}/v{v}/__bucket={b}")
                fs.delete(where, True)


def apply_batch(store: Store, requests: DataFrame, version: int, secret: bytes | None = None, resolve: bool = False) -> None:
    """One micro-batch into the store: receipts first known from the log of keys, then the targets in order, the key log last.

    Requests of one key are ranked by arrival: the first that is accepted is applied and its
    digest logged, others of the micro-batch are duplicates of it or in conflict with it.
    With resolve, a new seller that certainly is one that is known becomes merged, and what
    comes with it points at the known one; all matches go into the log of decisions.
    With a secret, requests must be signed, in time, and bring a nonce that wasn't used. A
    micro-batch that is run again after a failure starts from the versions before it and
    writes the same ones, so nothing is applied twice.
    """
    requests = requests.persist()
    if secret is not None:
        requests = _admitted(store, requests, secret, version)
    accepted, rejected = B.validated(requests)
    order = [c for c in ("arrived", "file", "body_sha256") if c in accepted.columns]
    seen = store.log("keys", version)
    if seen is None:
        seen = accepted.select("idempotency_key", "body_sha256").limit(0)
    judged = classify_ingest(seen, accepted, "idempotency_key", "body_sha256", order).persist()
    fresh = judged.filter("receipt = 'new'")
    store.write("receipts", judged.select("idempotency_key", "body_sha256", "writes", "receipt"), version)
    store.write("rejects", rejected.select("body", "errors"), version)
    _write_targets(store, fresh, version, resolve)
    store.write("keys", fresh.select("idempotency_key", "body_sha256"), version)
    judged.unpersist()
    requests.unpersist()


def _write_targets(store: Store, fresh: DataFrame, version: int, resolve: bool) -> None:
    """The rows of accepted requests into their targets, in order."""
    sizes = fresh.agg(*[F.coalesce(F.sum(F.size(name)), F.lit(0)).alias(name) for name in TARGETS]).first()
    moved = _resolved(store, fresh, version) if resolve and sizes["sellers"] else None
    for name, (keys, policy) in TARGETS.items():
        if sizes[name]:
            rows = B.fan_out(fresh, name).withColumn("__at", F.struct("__number", "__place", "__run")).select(*B.ARRAYS[name], "__at")
            if moved is not None and name == "sellers":
                gone = moved.select(F.col("source_id").alias("__from"))
                rows = rows.join(gone, F.col("id") == F.col("__from"), "left").withColumn("status", F.when(F.col("__from").isNotNull(), "merged").otherwise(F.col("status"))).drop("__from")
            elif moved is not None and "seller_id" in B.ARRAYS[name]:
                rows = X.repoint(rows, moved).select(*B.ARRAYS[name], "__at")
            store.merge(name, rows, keys, B.ARRAYS[name], _combine(keys, policy, B.ARRAYS[name], STICKY.get(name, {})), version)


def _resolved(store: Store, fresh: DataFrame, version: int) -> DataFrame | None:
    """Merges (source_id, target_id) of new sellers into known ones; all decisions, redirects and the links that are moved are stored.

    Names, domains, places and contact hashes count. What a decision needs to be taken back
    is written before anything moves: merge_links has each row that came with a merged
    seller, by table and id (operators.resolution.rollback), redirects the pair itself.
    """
    known = store.before("sellers", version)
    if known is None:
        return None
    who = lambda df: df.select("id", F.col("normalized_name").alias("name"), F.col("official_domain").alias("domain"), F.col("country_code").alias("country"), "city", F.coalesce("status", F.lit("active")).alias("status"))
    of = lambda rows: rows.groupBy(F.col("seller_id").alias("__s")).agg(F.collect_set("normalized_hash").alias("hashes"))
    hashed = lambda df, rows: df.join(of(rows), F.col("id") == F.col("__s"), "left").drop("__s")
    new = who(B.fan_out(fresh, "sellers")).dropDuplicates(["id"]).join(known.select("id"), "id", "left_anti")
    old = who(known)
    pairs = X.candidates(new, old)
    contacts = store.before("contacts", version)
    if contacts is not None:
        met = pairs.select(F.col("existing_id").alias("__e")).distinct()
        contacts = contacts.join(met, F.col("seller_id") == F.col("__e"), "left_semi")
        new, old = hashed(new, B.fan_out(fresh, "contacts")), hashed(old, contacts)
    best = X.best(X.score(pairs, new.drop("status"), old.drop("status")))
    made = best.select(F.col("candidate_id").alias("source_id"), F.col("existing_id").alias("target_id"), "score", X.action(F.col("score")).alias("action"))
    made = made.withColumn("id", uuid7("entity-resolution-decision", F.concat_ws(":", "source_id", "target_id")))
    store.write("decisions", made, version)
    sure = store.spark.read.schema(made.schema).parquet(f"{store.path}/decisions/v{version}").filter("action = 'auto_merge'")
    moved = {name: B.fan_out(fresh, name).select("id", "seller_id") for name in TARGETS if "seller_id" in B.ARRAYS[name]}
    store.write("merge_links", X.merge_links(moved, sure), version)
    store.write("redirects", sure.select("source_id", "target_id", F.col("id").alias("decision_id"), F.lit("active").alias("status")), version)
    return sure


def _combine(keys: list[str], policy, columns: list[str], sticky: dict[str, str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    if policy == ONCE:
        return lambda old, new: insert_only(old, new, keys, [F.asc("__at")], columns)
    return lambda old, new: upsert(old, new, keys, policy, order="__at", sticky={c: F.expr(cond) for c, cond in sticky.items()})


def _admitted(store: Store, requests: DataFrame, secret: bytes, version: int) -> DataFrame:
    """The signed requests that may be looked at; the others and the nonces go into the store."""
    judged = B.authenticated(requests, secret)
    used = store.log("nonces", version)
    if used is None:
        used = requests.select("nonce").limit(0)
    sound = judged.filter("refused IS NULL")
    marked = replayed(sound, used)
    store.write("refused", judged.filter("refused IS NOT NULL").select("nonce", "refused").unionByName(marked.filter("replay").select("nonce", F.lit("replayed_nonce").alias("refused"))), version)
    admitted = marked.filter("not replay")
    store.write("nonces", admitted.select("nonce"), version)
    return admitted.drop("replay", "refused")


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, secret: bytes | None = None, resolve: bool = False, allowed: list[str] | None = None, nonce_ttl: int = A.NONCE_TTL, key_ttl: int = A.KEY_TTL) -> StreamingQuery:
    """A streaming query that takes the files of source in as they come.

    With a secret each line is a signed request (batches.read_signed). Which requests are
    admitted is a matter of the stream's state (streaming.admission); apply_admitted writes
    them. allowed: hosts that sources may have.
    """
    store = Store(spark, target)
    requests = (B.read if secret is None else B.read_signed)(spark, source, stream=True)

    def each(df: DataFrame, number: int) -> None:
        apply_admitted(store, df, number, resolve)

    before = {k: spark.conf.get(k, None) for k in A.SETTINGS}
    try:
        for k, v in A.SETTINGS.items():
            spark.conf.set(k, v)
        return A.admitted(requests, secret, allowed, nonce_ttl, key_ttl).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:  # a query keeps the settings that it was started with
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def apply_admitted(store: Store, requests: DataFrame, version: int, resolve: bool = False) -> None:
    """One micro-batch of admission.admitted into the store: reports of what was refused and rejected, receipts, then the targets of new requests."""
    requests = requests.persist()
    receipts = requests.filter(F.col("outcome").isin("new", "duplicate", "conflict"))
    store.write("receipts", receipts.select("idempotency_key", "body_sha256", "writes", F.col("outcome").alias("receipt")), version)
    bad = F.col("outcome").isin("invalid_schema", "source_policy_rejected")
    store.write("rejects", requests.filter(bad).select("body", "errors"), version)
    if "nonce" in requests.columns:
        store.write("refused", requests.filter(~bad & ~F.col("outcome").isin("new", "duplicate", "conflict")).select("nonce", F.col("outcome").alias("refused")), version)
    fresh = B.parsed(requests.filter("outcome = 'new'").drop("errors", "idempotency_key", "body_sha256", "outcome")).persist()
    _write_targets(store, fresh, version, resolve)
    store.write("keys", fresh.select("idempotency_key", "body_sha256"), version)  # a record; the stream itself never reads it
    fresh.unpersist()
    requests.unpersist()


def replayed(requests: DataFrame, used: DataFrame, nonce: str = "nonce", order: list[str] | None = None) -> DataFrame:
    """requests with replay: the nonce was used before, or by an earlier one of them (by order)."""
    from pyspark.sql import Window

    order = order or [c for c in ("arrived", "body") if c in requests.columns]
    w = Window.partitionBy(nonce).orderBy(*order)
    known = used.select(F.col(nonce).alias("__used")).distinct()
    out = requests.withColumn("__k", F.row_number().over(w)).join(known, F.col(nonce) == F.col("__used"), "left")
    return out.withColumn("replay", F.col("__used").isNotNull() | (F.col("__k") > 1)).drop("__k", "__used")


def first_nonces(stream: DataFrame, nonce: str, at: str, keep: str = "10 minutes") -> DataFrame:
    """The first row of each nonce within keep; replays are dropped, state is dropped as the watermark passes."""
    return stream.withWatermark(at, keep).dropDuplicatesWithinWatermark([nonce])


def timely(happened, arrived, seconds: int = B.TIME_WINDOW):
    """Whether a row's own time is within seconds of its arrival, before or after."""
    return F.abs(F.unix_timestamp(arrived) - F.unix_timestamp(happened)) <= seconds


def in_time(rows: DataFrame, happened: str, arrived: str, seconds: int = B.TIME_WINDOW) -> DataFrame:
    return rows.filter(timely(happened, arrived, seconds))


def latest_states(log: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    return log.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state))


def by_day(rows: DataFrame, at: str, state: str = "state") -> DataFrame:
    """Rows and errors for each day."""
    days = rows.groupBy(F.window(at, "1 day").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col(state) == "error").alias("errors"))
    return days.select(F.col("w.start").alias("day"), "n", "errors")


def daily(stream: DataFrame, at: str, late: str = "1 day") -> DataFrame:
    """by_day of a stream, given out as the watermark passes the day."""
    return by_day(stream.withWatermark(at, late), at)
