"""Functions and a table function for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: SQL functions made of built-in expressions, in SQL: name(arguments) -> body.
SQL = {
    "heddle_masked_email(c STRING)": "concat(CASE WHEN length(substring_index(c, '@', 1)) <= 2 THEN left(c, 1) ELSE left(c, 2) END, '***@', substring_index(c, '@', -1))",
    "heddle_namespaced_hash(namespace STRING, c STRING)": "sha2(concat(namespace, char(0), c), 256)",
    "heddle_like_contains(c STRING, needle STRING)": "contains(lower(c), lower(needle))",
    "heddle_review_status(confidence INT)": "CASE WHEN confidence >= 80 THEN 'accepted' WHEN confidence >= 55 THEN 'manual_review' END",
}


@F.udtf(returnType="kind string, raw string")
class ExtractLinks:
    """Links of a page by kind: SELECT t.* FROM pages, LATERAL heddle_links(html) t."""

    KINDS = {"mailto:": "email", "tel:": "phone", "whatsapp:": "whatsapp", "http://": "web", "https://": "web"}

    def eval(self, html: str):
        from heddle.operators.extraction import page_document

        for link in page_document(html)[1]:
            yield next((kind for scheme, kind in self.KINDS.items() if link.lower().startswith(scheme)), "relative"), link


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to spark.sql; their names."""
    from heddle.functions import text
    from heddle.operators.extraction import canonical_url, parse_html

    names = []
    for head, body in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
        names.append(head.split("(")[0])
    for name, fn in {"heddle_nfkc": text.nfkc, "heddle_casefold": text.casefold, "heddle_sequence_ratio": text.sequence_ratio, "heddle_canonical_url": canonical_url, "heddle_parse_html": parse_html}.items():
        spark.udf.register(name, fn)
        names.append(name)
    spark.udtf.register("heddle_links", ExtractLinks)
    return [*names, "heddle_links"]
