"""Encrypted mappings: AES-256-GCM with the header as additional data.

A container is ``magic | version | header length | header JSON | IV | body | tag``.
Keys are ready 32-byte keys in a small table ``keys(domain, key)``; they reach
the query as data and so never show up in plans. A key per domain keeps cell
maps, sources and text mappings apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAGIC = b"CLKM"
VERSION = 2
ENTRY_SCHEMA = "array<struct<original:string,masked:string,rule_id:string>>"
HEADER_SCHEMA = "struct<artifact_id:string,created_at:string,aead_name:string>"


def _be32(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n), 8, "0"))


def _with_key(df: DataFrame, keys: DataFrame, domain: str) -> DataFrame:
    """Attach the key of a domain, null where there is none; the key table is reduced to that single row first."""
    one = keys.filter(F.col("domain") == domain).select(F.col("domain").alias("_domain"), F.col("key").alias("_key")).limit(1)
    return df.withColumn("_domain", F.lit(domain)).join(F.broadcast(one), "_domain", "left").drop("_domain")


def encrypt_payload(df: DataFrame, payload: Column, artifact_id: Column, created_at: Column, keys: DataFrame, domain: str) -> DataFrame:
    """Add ``container`` and ``error_code``; without a key the row stays, with ``KEY_MISSING`` and no container.

    The IV is drawn by Spark for every row anew.
    """
    header = F.to_json(F.struct(artifact_id.cast("string").alias("artifact_id"), created_at.alias("created_at"), F.lit("AES-256-GCM").alias("aead_name")))
    work = _with_key(df.withColumns({"_h": header.cast("binary"), "_p": payload.cast("binary")}), keys, domain)
    prefix = F.concat(F.lit(MAGIC), F.lit(bytes([VERSION])), _be32(F.octet_length("_h")), F.col("_h"))
    work = work.withColumn("_aad", prefix)
    body = F.aes_encrypt("_p", "_key", F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), "_aad")
    out = work.withColumn("container", F.concat("_aad", body)).withColumn("error_code", F.when(F.col("_key").isNull(), "KEY_MISSING"))
    return out.drop("_h", "_p", "_key", "_aad")


def check_encrypted(df: DataFrame) -> DataFrame:
    """Refuse to write while a row has no key."""
    if not df.filter("error_code IS NOT NULL").isEmpty():
        raise ValueError("KEY_MISSING: there is no key for the domain")
    return df


def encrypt_mappings(df: DataFrame, mapping_col: str, id_col: str, created_at: Column, keys: DataFrame, domain: str = "mapping") -> DataFrame:
    entries = F.transform(
        mapping_col, lambda m: F.struct(m["original"].alias("original"), m["masked"].alias("masked"), m["rule_id"].alias("rule_id"))
    )
    return encrypt_payload(df, F.to_json(entries), F.col(id_col), created_at, keys, domain)


def decrypt_payload(df: DataFrame, keys: DataFrame, domain: str, container_col: str = "container") -> DataFrame:
    """Add ``payload`` (binary), ``header`` and ``error_code``.

    No magic or another version: ``CMAP_VERSION_UNSUPPORTED``; wrong key,
    changed or cut container: ``CMAP_AUTH_FAILED``; no key: ``KEY_MISSING``.
    """
    c = F.col(container_col)
    known = (F.octet_length(c) >= 9) & (F.substring(c, 1, 4) == F.lit(MAGIC)) & (F.substring(c, 5, 1) == F.lit(bytes([VERSION])))
    work = _with_key(df, keys, domain).withColumn("_known", F.coalesce(known, F.lit(False)))
    size = F.when(F.col("_known"), F.conv(F.hex(F.substring(c, 6, 4)), 16, 10).cast("bigint"))
    work = work.withColumn("_n", F.when(size <= F.octet_length(c) - 9, size.cast("int")))
    aad = F.substring(c, F.lit(1), 9 + F.col("_n"))
    body = F.substring(c, 10 + F.col("_n"), F.octet_length(c))
    # IV and tag take 28 bytes; shorter bodies are cut containers
    plain = F.when(F.octet_length(body) >= 28, F.try_aes_decrypt(body, "_key", F.lit("GCM"), F.lit("DEFAULT"), aad))
    header = F.from_json(F.substring(c, F.lit(10), F.col("_n")).cast("string"), HEADER_SCHEMA)
    return (
        work.withColumn("payload", plain)
        .withColumn("header", F.when(F.col("payload").isNotNull(), header))
        .withColumn("error_code", F.when(~F.col("_known"), "CMAP_VERSION_UNSUPPORTED").when(F.col("_key").isNull(), "KEY_MISSING").when(F.col("payload").isNull(), "CMAP_AUTH_FAILED"))
        .drop("_key", "_known", "_n")
    )


def decrypt_mappings(df: DataFrame, keys: DataFrame, domain: str = "mapping", container_col: str = "container") -> DataFrame:
    out = decrypt_payload(df, keys, domain, container_col)
    return out.withColumn("mapping", F.from_json(F.col("payload").cast("string"), ENTRY_SCHEMA)).drop("payload")


def read_keys(spark, path: str) -> DataFrame:
    """Key file: JSON lines with ``domain`` and a base64 ``key``."""
    raw = spark.read.schema("domain STRING, key STRING").json(path)
    return raw.select("domain", F.unbase64("key").alias("key"))
