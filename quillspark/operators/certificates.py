"""Certificates of barcode signatures: authority to trust service, requests, keys by (authority, cert_id).

Reference tables are small by nature (a trust list has some tens of services), and still they join by
size statistics, not by a forced broadcast. Nothing is fetched while barcodes are verified: requests
are made and answered apart, and their table of keys joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.ddoc import TEST_KEY, named_certificate
from quillspark.functions.x509 import public_key_of
from quillspark.sources.fetch import fetched

# Fixed value: the authority whose documents are specimens, signed with the published test key.
TEST_AUTHORITY = "FR00"


def trust_services(providers: DataFrame) -> DataFrame:
    """authority, uri and certificate: the first of each provider name, from rows (provider, uri, certificate[, ord])."""
    place = F.col("ord") if "ord" in providers.columns else F.struct("uri", "certificate")
    return providers.groupBy(F.col("provider").alias("authority")).agg(F.min_by(F.struct("uri", "certificate"), place).alias("x")).select("authority", "x.uri", "x.certificate")


def certificate_requests(barcodes: DataFrame, services: DataFrame, column: str = "barcode_text") -> DataFrame:
    """authority, cert_id, url and error of every certificate that barcodes name, once each.

    The specimens' authority needs none. An authority that no service names has an error and no url.
    """
    h = named_certificate(F.col(column))
    named = barcodes.select(h.alias("h")).where("h is not null").select("h.authority", "h.cert_id").distinct().where(F.col("authority") != TEST_AUTHORITY)
    joined = named.join(services.select(F.col("authority").alias("a"), "uri"), F.col("authority") == F.col("a"), "left")
    mark = F.when(F.contains("uri", F.lit("?")), "&").otherwise("?")
    url = F.concat("uri", mark, F.lit("name="), F.url_encode("cert_id"))
    return joined.select("authority", "cert_id", url.alias("url"), F.when(F.col("uri").isNull(), "unknown authority").alias("error"))


def keys_of(answers: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """authority, cert_id, key and error of answered requests (authority, cert_id, content, error): the keys' table."""
    key = public_key_of(F.col("content"))
    read = answers.select("authority", "cert_id", key.alias("key"), F.col("error").alias("fault"))
    return read.select("authority", "cert_id", "key", F.coalesce("fault", F.when(F.col("key").isNull(), "no P-256 key in the certificate")).alias("error"))


def fetched_keys(barcodes: DataFrame, services: DataFrame, column: str = "barcode_text") -> DataFrame:
    """``keys_of`` for what barcodes name, asked for by URL in tasks; refusals are errors on their rows."""
    asked = certificate_requests(barcodes, services, column)
    got = fetched(asked.where("url is not null").select("url", F.lit(None).cast("string").alias("hint"))).select(F.col("url").alias("u"), "content", F.col("error").alias("refusal"))
    answers = asked.join(got, F.col("url") == F.col("u"), "left").select("authority", "cert_id", "content", F.coalesce("error", "refusal").alias("error"))
    return keys_of(answers)


def with_test_key(barcodes: DataFrame, keys: DataFrame, column: str = "barcode_text") -> DataFrame:
    """``keys`` with the published test key for every certificate of the specimens' authority that barcodes name."""
    h = named_certificate(F.col(column))
    specimens = barcodes.select(h.alias("h")).where(F.col("h.authority") == TEST_AUTHORITY).select("h.authority", "h.cert_id").distinct()
    return keys.where(F.col("key").isNotNull()).select("authority", "cert_id", "key").unionByName(specimens.withColumn("key", F.lit(TEST_KEY)))
