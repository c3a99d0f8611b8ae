"""Ingest batches (JSON documents), their contract, and the spool of batches that wait to be sent again.

A batch is one line of JSON. It is looked at as a variant first, so that unknown fields and
wrong types are seen where a schema would drop them, and read by the schema after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.ids import hmac_sha256, is_uuid7
from heddle.operators.lineage import once

RAW_BYTES, GZIP_BYTES = 1 << 20, 256 << 10
MOST = {"sellers": 25, "contacts": 100}
WRITES = 20
#: Seconds that a request's own time may differ from its arrival.
TIME_WINDOW = 300
ENVELOPE = r"^si-aesgcm:v1:[A-Za-z0-9._-]{1,32}:[A-Za-z0-9_-]+:[A-Za-z0-9_-]+$"

# fixed values: fields of a batch and of the rows of its arrays with their types; an exclamation mark: required
HEAD = "schema_version one!, parser_version text!, crawl_run_id uuid!, batch_number count!, generated_at text!"
FIELDS = {
    "sellers": """schema_version one!, parser_version text!, id uuid!, canonical_name text!, normalized_name text!, legal_name text, legal_name_local text, country_code text, province text, city text,
        address_private text, address_public_masked text, official_domain text, china_confidence count, identity_confidence count, manufacturer_score whole, trader_score whole, quality_score count,
        status text, first_seen_at text!, last_seen_at text!, last_material_change_at text, created_at text!, updated_at text!""",
    "marketplace_accounts": """id uuid!, seller_id uuid!, marketplace text!, merchant_token text, display_name text, profile_url text, storefront_url text, rating number, feedback_count count,
        positive_feedback_percent number, country_hint text, first_seen_at text!, last_seen_at text!, status text""",
    "seller_aliases": "id uuid!, seller_id uuid!, alias text!, normalized_alias text!, language_code text, alias_type text!, source_id uuid, first_seen_at text!, last_seen_at text!",
    "score_components": "id uuid!, seller_id uuid!, score_type text!, rule_code text!, points whole!, evidence_source_id uuid, explanation text!, observed_at text!, parser_version text!",
    "product_links": """schema_version one!, parser_version text!, id uuid!, seller_id uuid!, product_name text!, normalized_product_name text!, brand text, normalized_brand text, category text, product_url text,
        source_id uuid, first_seen_at text!, last_seen_at text!, status text""",
    "contacts": """schema_version one!, parser_version text!, id uuid!, seller_id uuid!, contact_type text!, contact_value_ciphertext sealed!, normalized_hash text!, display_value_masked text, classification text!,
        confidence share!, source_id uuid!, first_seen_at text!, last_seen_at text!, last_verified_at text, status text, outreach_eligible flag""",
    "suppressions": "id uuid!, seller_id uuid, contact_hash text, domain text, reason text!, created_at text!, expires_at text",
    "outreach_states": """schema_version one!, parser_version text!, id uuid!, seller_id uuid!, contact_id uuid, outreach_status text, channel text, last_outreach_at text, next_allowed_at text,
        operator_notes text, updated_at text!""",
    "audit_events": """id uuid!, event_type text!, entity_type text!, entity_id text!, actor_id text, old_value_hash text, new_value_hash text, old_value_masked text, new_value_masked text, reason text,
        metadata_json text, created_at text!""",
    "sources": """schema_version one!, parser_version text!, id uuid!, seller_id uuid, source_url text!, canonical_url text!, source_domain text!, source_type text!, robots_status text, terms_risk text,
        http_status count, page_title text, evidence_snippet text, content_hash text, r2_object_key text, detected_at text, last_seen_at text, first_seen_at text!, last_fetched_at text, last_success_at text,
        next_allowed_at text, status text""",
    "crawl_runs": """id uuid!, job_type text!, zyte_job_id text, started_at text!, finished_at text, status text!, requests_total count, responses_success count, candidates_found count, records_created count,
        records_updated count, contacts_verified count, blocked_count count, error_count count, notes text""",
    "review_queue_items": "id uuid!, review_type text!, entity_id text!, priority count, payload_json text!, reason text!, status text, created_at text!, reviewed_at text, reviewed_by text",
    "source_registry": """adapter_name text!, source_family text!, enabled flag, risk_level text!, robots_policy text!, terms_review_status text!, daily_request_budget count, concurrency_per_domain count,
        minimum_delay_seconds number, blocked_until text, parser_version text!, last_success_at text, last_failure_at text, operator_notes text""",
    "quota_states": "quota_name text!, window_start text!, used count, soft_limit count!, hard_limit count!, updated_at text!",
    "feature_flags": "flag_name text!, enabled flag, source text, updated_at text!, operator_notes text",
    "field_history": """id uuid!, entity_type text!, entity_id text!, field_name text!, old_value_hash text, new_value_hash text, old_value_masked text, new_value_masked text, source_id uuid, observed_at text!,
        crawl_run_id uuid, actor_type text, actor_id text, change_reason text, diff_json text, schema_version one!""",
    "recent_diff_metadata": """id uuid!, entity_type text!, entity_id text!, latest_field_history_id uuid, diff_count_30d count, last_observed_at text!, schema_version one!, updated_at text!""",
}

#: Type of a field -> column type.
TYPES = {"text": "string", "uuid": "string", "sealed": "string", "one": "int", "count": "bigint", "whole": "bigint", "share": "int", "number": "double", "flag": "boolean"}


def fields(spec: str) -> dict[str, tuple[str, bool]]:
    """Field -> type and whether it is required."""
    return {name: (kind.rstrip("!"), kind.endswith("!")) for name, kind in (f.split() for f in spec.split(","))}


def ddl(array: str) -> str:
    return ", ".join(f"{name} {TYPES[kind]}" for name, (kind, _) in fields(FIELDS[array]).items())


#: Array -> column names of its rows.
ARRAYS = {a: list(fields(spec)) for a, spec in FIELDS.items()}
BATCH = ", ".join([f"{n} {TYPES[k]}" for n, (k, _) in fields(HEAD).items()] + [f"{a} array<struct<{ddl(a)}>>".replace(" string", ": string").replace(" bigint", ": bigint").replace(" int", ": int").replace(" double", ": double").replace(" boolean", ": boolean") for a in FIELDS])


def read(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Requests: body (one line of JSON; gzip files are read as they are), file, and arrived, the file's time."""
    reader = spark.readStream if stream else spark.read
    meta = F.col("_metadata")
    return reader.text(path).select(F.col("value").alias("body"), meta["file_path"].alias("file"), meta["file_modification_time"].alias("arrived"), meta["file_size"].alias("file_bytes"))


SIGNED = "timestamp string, nonce string, signature string, body string"


def read_signed(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Signed requests: each line a JSON object with timestamp, nonce, signature and body (the batch's own text), beside file, arrived and file_bytes."""
    rows = read(spark, path, stream).withColumn("__r", F.from_json("body", SIGNED))
    return rows.select(*[F.col(f"__r.{c}").alias(c) for c in ("timestamp", "nonce", "signature", "body")], "file", "arrived", "file_bytes")


#: Hosts that a source may not have. fixed values
BLOCKED_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0", "::1"]


def source_errors(sources: Column, allowed: list[str] | None = None) -> Column:
    """array<string>: what is wrong with the URLs of a batch's sources; allowed: hosts, if only some may be."""

    def errors(s: Column, i: Column) -> Column:
        at = F.concat(F.lit("$.sources["), i.cast("string"), F.lit("]"))
        part = lambda url, what: F.try_parse_url(s[url], F.lit(what))
        bad_url = {u: part(u, "PROTOCOL").isNull() for u in ("source_url", "canonical_url")}
        host = F.lower(F.regexp_replace(part("source_url", "HOST"), r"^\[|\]$", ""))
        rules = [(bad_url[u], f".{u} must be a valid URL") for u in bad_url]
        sound = ~bad_url["source_url"] & ~bad_url["canonical_url"]
        rules += [(sound & ~F.lower(part(u, "PROTOCOL")).isin("http", "https"), f".{u} must use http or https") for u in bad_url]
        rules.append((sound & (part("source_url", "USERINFO").isNotNull() | part("canonical_url", "USERINFO").isNotNull()), " URLs must not include credentials"))
        rules.append((sound & host.isin(BLOCKED_HOSTS), ".source_url must not target localhost or private test hosts"))
        rules.append((sound & ~host.eqNullSafe(F.lower(s["source_domain"])), ".source_domain must match source_url hostname"))
        if allowed:
            rules.append((sound & ~F.coalesce(host.isin(allowed), F.lit(False)), ".source_url hostname is not in the ingestion allowlist"))
        return F.filter(F.array(*[F.when(bad, F.concat(at, F.lit(what))) for bad, what in rules]), lambda e: e.isNotNull())

    none = F.array().cast("array<string>")
    return F.coalesce(F.flatten(F.transform(sources, errors)), none)


def authenticated(requests: DataFrame, secret: bytes, window: int = TIME_WINDOW) -> DataFrame:
    """requests (timestamp, nonce, signature, body, arrived) with refused: why one is not to be looked at, or null.

    The signature is the HMAC of timestamp.nonce.digest; the time must be within window
    seconds of the arrival. Replays of nonces are a matter of state: streaming.ingest.
    """
    missing = F.coalesce(F.trim("timestamp") == "", F.lit(True)) | F.coalesce(F.trim("nonce") == "", F.lit(True)) | F.coalesce(F.trim("signature") == "", F.lit(True))
    at = F.try_to_timestamp("timestamp")
    late = ~F.coalesce(F.abs(F.unix_timestamp(at) - F.unix_timestamp("arrived")) <= window, F.lit(False))
    wanted = hmac_sha256(secret, F.concat_ws(".", "timestamp", "nonce", F.sha2("body", 256)))
    forged = F.lower("signature") != wanted
    return requests.withColumn("refused", F.when(missing, "missing_ingestion_header").when(late, "expired_timestamp").when(forged, "invalid_signature"))


def _get(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _record_errors(path: Column, record: Column, spec: dict[str, tuple[str, bool]], arrays: tuple[str, ...] = ()) -> Column:
    """What is wrong with the fields of a record, a map of variants."""
    names = lambda ok: [n for n, (kind, need) in spec.items() if ok(kind, need)]

    def among(fields_: list[str], bad, what: str) -> Column:
        if not fields_:
            return F.array().cast("array<string>")
        found = F.filter(F.array(*[F.lit(n) for n in fields_]), lambda n: bad(F.try_element_at(record, n)))
        return F.transform(found, lambda n: F.concat(path, F.lit("."), n, F.lit(what)))

    kind_of = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    there = lambda v: kind_of(v) != "VOID"
    text = lambda v: kind_of(v) == "STRING"
    number = lambda v: kind_of(v).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$")
    whole = lambda v: number(v) & F.coalesce(_get(v, "double") == F.floor(_get(v, "double")), F.lit(False))
    within = lambda v, low, high=None: whole(v) & (_get(v, "double") >= low) & ((_get(v, "double") <= high) if high is not None else F.lit(True))
    checks = {
        "text": (text, " must be a string"),
        "uuid": (lambda v: text(v) & F.coalesce(is_uuid7(_get(v, "string")), F.lit(False)), " must be a version 7 UUID"),
        "sealed": (lambda v: text(v) & F.coalesce(_get(v, "string").rlike(ENVELOPE), F.lit(False)), " must be a sealed value"),
        "one": (lambda v: within(v, 1, 1), " must be 1"),
        "count": (lambda v: within(v, 0), " must be a non-negative integer"),
        "share": (lambda v: within(v, 0, 100), " must be an integer between 0 and 100"),
        "whole": (whole, " must be an integer"),
        "number": (number, " must be a number"),
        "flag": (lambda v: kind_of(v) == "BOOLEAN", " must be a boolean"),
    }
    out = [
        among(names(lambda kind, need: need), lambda v: ~there(v) | (text(v) & (_get(v, "string") == "")), " is required"),
        F.transform(F.filter(F.map_keys(record), lambda n: ~n.isin(*spec, *arrays)), lambda n: F.concat(path, F.lit("."), n, F.lit(" is not allowed"))),
        among(list(arrays), lambda v: there(v) & ~F.startswith(kind_of(v), F.lit("ARRAY")), " must be an array"),
    ]
    wrong = lambda good: lambda v: there(v) & ~good(v)
    for kind, (good, what) in checks.items():
        out.append(among([n for n, (k, _) in spec.items() if k == kind], wrong(good), what))
    return F.concat(*out)


def _row_errors(array: str, spec: dict[str, tuple[str, bool]]):
    def errors(row: Column, i: Column) -> Column:
        at = F.concat(F.lit(f"$.{array}["), i.cast("string"), F.lit("]"))
        record = _get(row, "map<string,variant>")
        return F.when(record.isNull(), F.array(F.concat(at, F.lit(" must be an object")))).otherwise(_record_errors(at, record, spec))

    return errors


def checked(requests: DataFrame) -> DataFrame:
    """requests with errors (array<string>, what is wrong with the body, in order) and writes, the rows of its arrays."""
    r = requests.withColumn("__v", F.when(F.octet_length("body") <= RAW_BYTES, F.try_parse_json(F.try_validate_utf8("body"))))
    r = r.withColumn("__top", _get(F.col("__v"), "map<string,variant>"))
    arrays = {a: F.coalesce(_get(F.try_element_at("__top", F.lit(a)), "array<variant>"), F.array().cast("array<variant>")) for a in FIELDS}
    r = r.withColumns({f"__{a}": rows for a, rows in arrays.items()})
    size = {a: F.size(f"__{a}") for a in FIELDS}
    writes = sum(size.values(), F.lit(0))
    path = F.lit("$")
    found = [_record_errors(path, F.col("__top"), fields(HEAD), tuple(FIELDS))]
    found += [F.flatten(F.transform(F.col(f"__{a}"), _row_errors(a, fields(spec)))) for a, spec in FIELDS.items()]
    over = [F.when(size[a] > most, F.lit(f"$.{a} exceeds maximum {most}")) for a, most in MOST.items()]
    over.append(F.when(writes > WRITES, F.lit(f"batch write count exceeds maximum {WRITES}")))
    found.append(F.filter(F.array(*over), lambda e: e.isNotNull()))
    one = lambda text: F.array(F.lit(text))
    errors = (
        F.when(F.octet_length("body") > RAW_BYTES, one("body is too large"))
        .when(~F.coalesce(F.is_valid_utf8("body"), F.lit(False)), one("body must be valid UTF-8"))
        .when(F.col("__v").isNull(), one("body must be valid JSON"))
        .when(F.col("__top").isNull(), one("body must be a JSON object"))
        .otherwise(F.array_sort(F.concat(*found)))
    )
    if "file_bytes" in requests.columns:
        packed = F.endswith(F.col("file"), F.lit(".gz")) & (F.col("file_bytes") > GZIP_BYTES)
        errors = F.when(packed, one("body is too large")).otherwise(errors)
    return once(r, errors=errors, writes=writes).drop("__v", "__top", *[f"__{a}" for a in FIELDS])


def parsed(sound: DataFrame) -> DataFrame:
    """Requests whose bodies keep the contract, with their batch's fields, idempotency_key run:number and body_sha256, the digest of the whole body."""
    rows = sound.withColumn("__b", F.from_json("body", BATCH))
    rows = rows.select(*[x for x in rows.columns if x != "__b"], "__b.*")
    return rows.withColumn("idempotency_key", F.concat_ws(":", "crawl_run_id", "batch_number")).withColumn("body_sha256", F.sha2("body", 256))


def validated(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): the accepted as parsed, the rejected with their errors."""
    c = checked(requests)
    return parsed(c.filter(F.size("errors") == 0).drop("errors")), c.filter(F.size("errors") > 0)


def fan_out(accepted: DataFrame, array: str) -> DataFrame:
    """The rows of one array, with their batch's run, number and place in the batch."""
    more = [c for c in ("arrived",) if c in accepted.columns]
    return accepted.select(F.col("crawl_run_id").alias("__run"), F.col("batch_number").alias("__number"), *more, F.posexplode(array).alias("__place", "r")).select("__run", "__number", "__place", *more, "r.*")


def stable_json(columns: list[str]) -> Column:
    """The columns as one JSON object, keys in order, nulls left out, nothing between."""
    return F.to_json(F.struct(*sorted(columns)))


def to_json_line(batches: DataFrame) -> DataFrame:
    return batches.select(stable_json(batches.columns).alias("body"))


def write(batches: DataFrame, path: str, compression: str = "gzip") -> None:
    """Batches as lines of JSON, in gzip files unless told otherwise."""
    to_json_line(batches).write.mode("overwrite").option("compression", compression).text(path)


SPOOL = "file_name string, body_base64 string, body_sha256 string, attempts int"


def read_spool(spark: SparkSession, path: str) -> DataFrame:
    """Spool records with ok: whether the body is the one that was put away."""
    return sound(spark.read.schema(SPOOL).json(path))


def sound(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ok", F.coalesce(F.sha2(F.unbase64("body_base64"), 256) == F.col("body_sha256"), F.lit(False)))


def write_spool(batches: DataFrame, path: str) -> None:
    out = to_json_line(batches).select(F.sha2("body", 256).alias("body_sha256"), F.translate(F.base64(F.encode("body", "UTF-8")), "\r\n", "").alias("body_base64"), F.lit(0).alias("attempts"))
    out.select(F.concat(F.substring("body_sha256", 1, 16), F.lit(".json")).alias("file_name"), "body_base64", "body_sha256", "attempts").write.mode("append").json(path)


def replay(spool: DataFrame, receipts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(to send, done, broken) of spool records: receipts (body_sha256, receipt) say which were taken in, as new or as duplicates; broken ones have another digest than their body."""
    taken = receipts.filter(F.col("receipt").isin("new", "duplicate")).select("body_sha256").distinct()
    sound = spool.filter("ok")
    send = sound.join(taken, "body_sha256", "left_anti").withColumn("body", F.decode(F.unbase64("body_base64"), "UTF-8"))
    return send.withColumn("attempts", F.col("attempts") + 1), sound.join(taken, "body_sha256", "left_semi"), spool.filter("not ok")
