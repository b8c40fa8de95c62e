"""Manifests of stored objects: hashing, key safety, verification, sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .digest import combine_hashes

# The default size limit and the marker of an empty folder.
DEFAULT_MAX_OBJECT_BYTES = 25 * 1024 * 1024
FOLDER_MARKER = ".emptyFolderPlaceholder"


def under_prefix(objects: DataFrame, prefix: str = "") -> DataFrame:
    """Objects below a key prefix, without folder markers."""
    prefix = prefix.strip("/")
    rows = objects.filter(F.element_at(F.split("path", "/"), -1) != FOLDER_MARKER)
    if not prefix:
        return rows
    return rows.filter((F.col("path") == prefix) | F.col("path").startswith(prefix + "/"))


def unsafe_key(path: Column) -> Column:
    """Why a key must not become a file path, or NULL if it may."""
    segments = F.split(path, "/")
    return (
        F.when(path == "", "empty")
        .when(path.startswith("/"), "absolute")
        .when(path.contains("\0"), "NUL byte")
        .when(path.contains("\\"), "backslash")
        .when(F.array_contains(segments, ""), "empty segment")
        .when(F.array_contains(segments, ".") | F.array_contains(segments, ".."), "dot segment")
    )


def object_violations(objects: DataFrame, max_bytes: int = DEFAULT_MAX_OBJECT_BYTES) -> DataFrame:
    """Keys that are unsafe and objects over the size limit.

    Looks at names and lengths only, so no content is read.
    """
    return objects.select(
        "path",
        F.coalesce(
            F.concat(F.lit("unsafe key: "), unsafe_key(F.col("path"))),
            F.when(F.col("length") > max_bytes, F.format_string(
                f"%d bytes, over the {max_bytes}-byte limit", F.col("length"))),
        ).alias("problem"),
    ).filter(F.col("problem").isNotNull())


def object_manifest(objects: DataFrame, content_type: Column | None = None) -> DataFrame:
    """``path, size, sha256, content_type``; size and hash come from the bytes.

    Write it with ``orderBy("path")`` where a sorted file is wanted.
    """
    return objects.select(
        "path",
        F.octet_length("content").cast("bigint").alias("size"),
        F.sha2(F.col("content"), 256).alias("sha256"),
        (content_type if content_type is not None else F.lit(None).cast("string"))
        .alias("content_type"),
    )


def manifest_digest(manifest: DataFrame) -> DataFrame:
    """``rows, sha256`` covering every path, size and hash of a manifest.

    Partial sums of per-entry hashes: no sort, and no task sees all entries.
    """
    entry = F.concat_ws(
        "\0", "path", F.col("size").cast("string"), "sha256",
        F.coalesce("content_type", F.lit("")),
    )
    hashed = manifest.select(F.sha2(entry, 256).alias("h"))
    return combine_hashes(hashed, F.col("h"))


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count(F.lit(1)).alias("objects"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.coalesce(F.max("size"), F.lit(0)).alias("largest"),
    )


def _paired(found: DataFrame, recorded: DataFrame) -> DataFrame:
    a = found.select("path", F.col("sha256").alias("found_sha"))
    b = recorded.select("path", F.col("sha256").alias("recorded_sha"))
    return a.join(b, "path", "full_outer")


def verify_objects(objects: DataFrame, manifest: DataFrame) -> DataFrame:
    """Objects that are missing, changed, or not in the manifest."""
    pairs = _paired(object_manifest(objects), manifest)
    problem = (
        F.when(F.col("found_sha").isNull(), "missing")
        .when(F.col("recorded_sha").isNull(), "not in manifest")
        .when(F.col("found_sha") != F.col("recorded_sha"), "changed")
    )
    return pairs.select("path", problem.alias("problem")).filter(F.col("problem").isNotNull())


def sync_plan(local: DataFrame, remote: DataFrame, drop_removed: bool = True) -> DataFrame:
    """What makes ``remote`` equal to ``local`` (both manifests): upload new and
    changed objects, drop the others."""
    action = (
        F.when(F.col("recorded_sha").isNull(), "upload")
        .when(F.col("found_sha").isNull(), "drop" if drop_removed else "keep")
        .when(F.col("found_sha") != F.col("recorded_sha"), "replace")
        .otherwise("keep")
    )
    return _paired(local, remote).select("path", action.alias("action")).filter("action <> 'keep'")
