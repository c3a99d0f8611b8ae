"""Queries of what an operator asks for: contacts revealed, a seller in detail, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import ids
from heddle.operators import health as H
from heddle.operators import listing as L
from heddle.plans.registry import query
from heddle.plans.relational import VISIBLE, Relations, as_of
from heddle.sources.domain import oracle, relation
from heddle.sources.export import EXPORT_ROWS

_KEY = b"0123456789abcdef0123456789abcdef"


def _asked(spark, d):
    """Contacts of some confidence with their sealed value; those whose hash begins with an a were sealed for another seller."""
    nonce = F.unhex(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 24))
    aad = F.when(F.startswith("hash", F.lit("a")), F.lit("contact:another")).otherwise(L.contact_aad())
    contacts = relation(spark, d, "contacts").filter("confidence >= 10")
    return contacts.withColumn("ciphertext", ids.seal(F.concat("contact_type", F.lit("@"), "hash"), F.lit(_KEY), nonce, aad))


def _revealed(spark, d):
    return L.reveal(_asked(spark, d), relation(spark, d, "suppressions"), F.lit(_KEY), "operator", "asked", as_of())


@query("contacts_revealed", oracle(f"WITH {VISIBLE} SELECT id, contact_type, CASE WHEN NOT starts_with(hash, 'a') THEN contact_type || '@' || hash END AS value FROM vis WHERE confidence >= 10"))
def contacts_revealed(spark, d):
    return _revealed(spark, d)[0]


@query("reveal_audit", oracle(f"WITH {VISIBLE} SELECT CAST(id AS VARCHAR) AS entity_id, hash AS old_value_hash, 'contact_revealed' AS event_type, 'operator' AS actor_id, 'asked' AS reason, true AS has_id FROM vis WHERE confidence >= 10 AND NOT starts_with(hash, 'a')"))
def reveal_audit(spark, d):
    return _revealed(spark, d)[1].select("entity_id", "old_value_hash", "event_type", "actor_id", "reason", ids.is_uuid7(F.col("id")).alias("has_id"))


_SELLER = 7


@query(
    "seller_detail",
    oracle(f"""WITH {VISIBLE}, parts AS (
      SELECT 'seller' AS part, 1 AS rank, id, name AS label FROM sellers WHERE id = {_SELLER}
      UNION ALL SELECT 'alias', row_number() OVER (ORDER BY alias, id), id, alias FROM aliases WHERE seller_id = {_SELLER}
      UNION ALL SELECT 'contact', row_number() OVER (ORDER BY last_seen DESC, id), id, contact_type FROM vis WHERE seller_id = {_SELLER}
      UNION ALL SELECT 'evidence', row_number() OVER (ORDER BY first_seen_at DESC, id), id, source_type FROM sources WHERE seller_id = {_SELLER}
      UNION ALL SELECT 'duplicate', row_number() OVER (ORDER BY score DESC, id), id, status FROM decisions WHERE candidate_id = {_SELLER} OR matched_id = {_SELLER})
    SELECT part, CAST(rank AS INTEGER) AS rank, id, label FROM parts WHERE rank <= 100"""),
)
def seller_detail(spark, d):
    return L.seller_detail(Relations(spark, d), _SELLER, as_of())


def _cell(column):
    text = f"coalesce(CAST({column} AS VARCHAR), '')"
    quoted = f"CASE WHEN regexp_matches({text}, '^[=+@\\-\\t\\r]') THEN chr(39) || {text} ELSE {text} END"
    return f"chr(34) || replace({quoted}, chr(34), chr(34) || chr(34)) || chr(34)"


_EXPORTED = ["id", "name", "country", "domain", "status", "last_seen_at"]
_LINE = " || ',' || ".join(_cell(c) for c in _EXPORTED)


@query(
    "sellers_exported",
    oracle(f"""WITH s AS (SELECT * FROM sellers WHERE status <> 'merged' AND manufacturer_score >= 15),
    r AS (SELECT *, row_number() OVER (ORDER BY last_seen_at DESC, id) AS place FROM s)
    SELECT CAST(place AS INTEGER) AS place, {_LINE} AS line FROM r WHERE place <= {EXPORT_ROWS}"""),
)
def sellers_exported(spark, d):
    """The listing's facets and order as rows of a CSV file, with the export's limit."""
    return L.export_sellers(Relations(spark, d), L.Facets(manufacturer=15), _EXPORTED)


@query(
    "runs_silent",
    oracle("""WITH e AS (SELECT *, lead(happened) OVER (PARTITION BY run_id ORDER BY happened, id) AS next, max(happened) OVER () AS until FROM log)
    SELECT run_id, state, happened AS since, happened + INTERVAL 2 DAY AS failed_at FROM e WHERE state <> 'purchase' AND coalesce(next, until) > happened + INTERVAL 2 DAY"""),
)
def runs_silent(spark, d):
    return H.silences(relation(spark, d, "log"), 2 * 86400, ["purchase"])
