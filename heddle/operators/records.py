"""Rows of the ingest contract from what extraction found. Ids are made from what identifies a row, so a row that is found again has the same id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions import ids, text as T
from heddle.operators.extraction import PARSER_VERSION, SCHEMA_VERSION

def identity_confidence(seen: Column, token: Column, business_name: Column) -> Column:
    """How sure an identity is by where it was seen (search, seller_page, official_site) and what was seen of it."""
    # fixed values: points
    return (
        F.when(seen == "search", F.when(token.isNotNull(), 80).otherwise(60))
        .when(seen == "seller_page", F.when(token.isNotNull() & business_name.isNotNull(), 90).otherwise(75))
        .when(seen == "official_site", 80)
    )


def _versions() -> list[Column]:
    return [F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(PARSER_VERSION).alias("parser_version")]


def _seen(at: Column) -> list[Column]:
    return [at.alias("first_seen_at"), at.alias("last_seen_at")]


def account_records(found: DataFrame, at: Column) -> DataFrame:
    """found: seller_id, marketplace, merchant_token, display_name, profile_url."""
    key = F.concat_ws(":", "marketplace", F.coalesce("merchant_token", F.lower("display_name")))
    return found.select(ids.uuid7("account", key).alias("id"), "seller_id", "marketplace", "merchant_token", "display_name", "profile_url", F.lit("active").alias("status"), *_seen(at))


def alias_records(found: DataFrame, at: Column, kind: str = "display_name") -> DataFrame:
    """found: seller_id, alias. One row for each normalized alias of a seller, that of the least spelling."""
    rows = found.filter("alias IS NOT NULL").withColumn("normalized_alias", T.company_name(F.col("alias"))["normalized"])
    rows = rows.groupBy("seller_id", "normalized_alias").agg(F.min("alias").alias("alias"))
    return rows.select(ids.uuid7("alias", F.concat_ws(":", "seller_id", "normalized_alias")).alias("id"), "seller_id", "alias", "normalized_alias", F.lit(kind).alias("alias_type"), *_seen(at))


def product_records(found: DataFrame, at: Column) -> DataFrame:
    """found: seller_id, product_name, brand, category, product_url."""
    key = F.concat_ws(":", "seller_id", F.coalesce("product_url", "product_name"))
    return found.select(
        *_versions(), ids.uuid7("product", key).alias("id"), "seller_id", "product_name", T.search_text(F.col("product_name")).alias("normalized_product_name"),
        "brand", T.search_text(F.col("brand")).alias("normalized_brand"), "category", "product_url", F.lit("active").alias("status"), *_seen(at),
    )


def source_records(pages: DataFrame, at: Column, kind: str = "official_site") -> DataFrame:
    """pages: seller_id, url, title, content_hash, evidence_snippet."""
    from heddle.operators.extraction import canonical_url

    rows = pages.withColumn("canonical_url", canonical_url("url", F.lit(None).cast("string"))).filter("canonical_url IS NOT NULL")
    return rows.select(
        *_versions(), ids.uuid7("source", F.col("canonical_url")).alias("id"), "seller_id", F.col("url").alias("source_url"), "canonical_url", T.domain(F.col("canonical_url")).alias("source_domain"),
        F.lit(kind).alias("source_type"), F.left("title", F.lit(200)).alias("page_title"), "evidence_snippet", "content_hash", at.alias("detected_at"), F.lit("active").alias("status"), *_seen(at),
    )


def contact_records(found: DataFrame, key: Column, nonce: Column, at: Column) -> DataFrame:
    """found: seller_id, source_id, contact_type, value, masked, classification, confidence. The value is sealed; only its hash and mask are plain."""
    return found.select(
        *_versions(), ids.uuid7("contact", F.concat_ws(":", "seller_id", "contact_type", "value")).alias("id"), "seller_id", "contact_type",
        ids.seal(F.col("value"), key, nonce, F.lit("contacts")).alias("contact_value_ciphertext"), ids.namespaced_hash("contact", F.col("value")).alias("normalized_hash"),
        F.col("masked").alias("display_value_masked"), "classification", "confidence", "source_id", F.lit("active").alias("status"), F.lit(False).alias("outreach_eligible"), *_seen(at),
    )


def first_names(found: DataFrame, order: list[str]) -> DataFrame:
    """domain, name: the name that was seen first with a domain."""
    return found.filter("domain IS NOT NULL AND name IS NOT NULL").groupBy("domain").agg(F.min_by("name", F.struct(*order)).alias("name"))


def approved_domains(known: Column, new: Column) -> Column:
    """Domains in order, each once: what is known, then what is new."""
    return F.array_distinct(F.concat(F.coalesce(known, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))))


def run_totals(log: DataFrame) -> DataFrame:
    """run_id, contacts_found so far after each of its batches. log: run_id, batch_number, contacts_found; a batch that was sent again counts once."""
    once = log.groupBy("run_id", "batch_number").agg(F.max("contacts_found").alias("contacts_found"))
    w = Window.partitionBy("run_id").orderBy("batch_number")
    return once.withColumn("total_found", F.sum("contacts_found").over(w))
