"""Sealed tables: a manifest with a digest of the content, chained to the version before, and signed.

The signature is HMAC-SHA256 with a shared key and is named so: whoever can verify can also sign. Data and
manifests lie side by side in any file system that Spark can reach.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import secrets
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriplane.runtime import exists, read_texts, write_text

MANIFEST_BYTES = 64_000
FIELDS = {"version", "parent", "digest", "algorithm", "signature_kind", "author", "message", "sealed_at"}


def content_digest(rows: DataFrame) -> str:
    """Order-free SHA-256 digest of a table's rows as canonical JSON.

    Row hashes are added up, in four 60-bit lanes, by a partial aggregate; no row leaves its executor.
    """
    whole = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    text = F.col("_digest")
    lanes = [F.sum(F.conv(F.substring(text, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"l{i}") for i in range(4)]
    got = rows.select(whole.alias("_digest")).agg(F.count("*").alias("n"), *lanes).first()
    return hashlib.sha256("|".join(str(x) for x in got).encode()).hexdigest()


def _sign(body: dict, key: bytes) -> str:
    return hmac.new(key, json.dumps(body, sort_keys=True).encode(), hashlib.sha256).hexdigest()


def _texts(spark: SparkSession, path: str) -> list[str]:
    return read_texts(spark, f"{path}/_manifests", ".json")


def seal(rows: DataFrame, path: str, author: str, key: bytes, message: str) -> dict:
    """Write the next version of a sealed table and return its manifest."""
    spark = rows.sparkSession
    done = _texts(spark, path)
    version, parent = len(done) + 1, hashlib.sha256(done[-1].encode()).hexdigest() if done else ""
    rows.write.parquet(f"{path}/v{version}")
    back = spark.read.parquet(f"{path}/v{version}")
    body = {"version": version, "parent": parent, "digest": content_digest(back), "algorithm": "sha256-multiset", "signature_kind": "hmac-sha256", "author": author, "message": message, "sealed_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
    manifest = body | {"signature": _sign(body, key)}
    write_text(spark, f"{path}/_manifests/{version:06d}.json", json.dumps(manifest, sort_keys=True))
    return manifest


def check_bounds(text: str) -> dict:
    """A manifest, parsed only if it is of a sane size and has exactly the fields of one; anything else raises ValueError."""
    if len(text) > MANIFEST_BYTES:
        raise ValueError("manifest too large")
    manifest = json.loads(text)
    if not isinstance(manifest, dict) or set(manifest) != FIELDS | {"signature"}:
        raise ValueError("not a manifest")
    if not isinstance(manifest["version"], int) or not all(isinstance(manifest[f], str) for f in FIELDS - {"version"}):
        raise ValueError("wrong type in manifest")
    return manifest


def verified_manifests(spark: SparkSession, path: str, keys: dict[str, bytes]) -> list[dict]:
    """The manifests of a sealed table in order, after bounds, chain, authors and signatures have been checked."""
    parent, out = "", []
    for n, text in enumerate(_texts(spark, path), 1):
        manifest = check_bounds(text)
        body = {k: v for k, v in manifest.items() if k != "signature"}
        if body["version"] != n or body["parent"] != parent:
            raise ValueError(f"broken chain at version {n}")
        if body["author"] not in keys:
            raise ValueError(f"unknown author at version {n}")
        if not hmac.compare_digest(manifest["signature"], _sign(body, keys[body["author"]])):
            raise ValueError(f"wrong signature at version {n}")
        parent = hashlib.sha256(text.encode()).hexdigest()
        out.append(body)
    if not out:
        raise ValueError("no version")
    return out


def load_verified(spark: SparkSession, path: str, keys: dict[str, bytes]) -> DataFrame:
    """The last version, after everything about it has been checked; anything wrong raises ValueError."""
    last = verified_manifests(spark, path, keys)[-1]
    rows = spark.read.parquet(f"{path}/v{last['version']}")
    if content_digest(rows) != last["digest"]:
        raise ValueError(f"content of version {last['version']} was changed")
    return rows


def seal_report(spark: SparkSession, path: str, keys: dict[str, bytes]) -> list[tuple[str, bool, str]]:
    """What was checked of a sealed table, whether it holds, and if not, why."""
    out = []
    for name, check in (("manifests", lambda: verified_manifests(spark, path, keys)), ("content", lambda: load_verified(spark, path, keys))):
        try:
            check()
            out.append((name, True, ""))
        except ValueError as e:
            out.append((name, False, str(e)))
    return out


def new_key(registry: dict[str, bytes], author: str) -> bytes:
    """Enrol an author with a fresh key; one that is enrolled already is an error."""
    if author in registry:
        raise ValueError(f"{author} is enrolled already")
    registry[author] = secrets.token_bytes(32)
    return registry[author]


def record_verdict(spark: SparkSession, path: str, entry: dict, allowed: dict[str, set[str]], author: str, key: bytes, keys: dict[str, bytes]) -> dict:
    """Append an entry to a sealed log as a new version, after the log has been verified.

    ``allowed`` names the columns of closed vocabularies. An empty value or one outside its vocabulary raises ValueError.
    Entries keep their order in ``log_pos``; ``latest`` gives the one that counts.
    """
    for name, value in entry.items():
        if not isinstance(value, str) or not value.strip():
            raise ValueError(f"{name} is empty")
        if name in allowed and value not in allowed[name]:
            raise ValueError(f"{name} may not be {value}")
    row = spark.createDataFrame([tuple(entry[c] for c in sorted(entry))], ", ".join(f"{c} string" for c in sorted(entry)))
    if not exists(spark, f"{path}/_manifests"):
        return seal(row.withColumn("log_pos", F.lit(1).cast("long")), path, author, key, "first entry")
    log = load_verified(spark, path, keys)
    last = log.agg(F.max("log_pos")).first()[0]
    return seal(log.unionByName(row.withColumn("log_pos", F.lit(last + 1))), path, author, key, f"entry {last + 1}")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and SHA-256 of the files of a folder, computed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def changed_files(now: DataFrame, sealed: DataFrame) -> DataFrame:
    """``(path, problem)``: files that differ from their manifest, are missing, or are in none."""
    both = sealed.select("path", F.col("sha256").alias("was")).join(now.select("path", F.col("sha256").alias("is")), "path", "full")
    problem = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "unknown").when(F.col("is") != F.col("was"), "changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def unsealed_evidence(evidence: DataFrame, manifests: DataFrame, column: str = "source_snapshot_hash") -> DataFrame:
    """Evidence whose source hash no sealed manifest has (anti-join)."""
    return evidence.join(manifests.select(F.col("sha256").alias(column)).distinct(), column, "left_anti")
