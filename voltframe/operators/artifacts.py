"""Model artifacts: immutable folders that appear whole or not at all, and can be checked against their digests."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltframe.operators.learners import QuantileForecaster
from voltframe.storage import delete, exists, rename_new

COMPONENT = re.compile(r"[A-Za-z0-9][A-Za-z0-9._=-]*")
DIGESTS = "digests"


def component(value: str, name: str) -> str:
    """A part of a path from a value that somebody else chose; nothing that could lead out of its folder."""
    if not COMPONENT.fullmatch(value or ""):
        raise ValueError(f"{name} cannot name a folder: {value!r}")
    return value


def artifact_folder(root: str, *, area: str, target: str, product: str, version: str) -> str:
    parts = {"area": area, "target": target, "product": product, "version": version}
    return "/".join([root.rstrip("/"), *(component(value, name) for name, value in parts.items())])


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """``file, length, sha256`` of every file of an artifact, by its path inside the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    inside = F.element_at(F.split("path", re.escape("/" + folder.rstrip("/").rsplit("/", 1)[1] + "/"), 2), 2)
    named = files.select(inside.alias("file"), "length", F.sha2("content", 256).alias("sha256"))
    return named.filter(~F.col("file").startswith(f"{DIGESTS}/"))


def publish(spark: SparkSession, folder: str, write: Callable[[str], None]) -> str:
    """Have ``write`` fill a hidden folder beside the target, add the digests of its files, and rename it to the target.

    A writer that dies leaves a hidden folder that nobody reads, and whatever was published before. An existing artifact is never
    replaced.
    """
    parent, name = folder.rstrip("/").rsplit("/", 1)
    if exists(spark, folder):
        raise FileExistsError(f"artifact {folder} exists")
    hidden = f"{parent}/.{name}-{uuid.uuid4().hex}"
    try:
        write(hidden)
        file_digests(spark, hidden).coalesce(1).write.parquet(f"{hidden}/{DIGESTS}")
        if not rename_new(spark, hidden, folder):
            raise FileExistsError(f"artifact {folder} exists")
    except Exception:
        delete(spark, hidden)
        raise
    return folder


def damaged_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of an artifact that are missing, added or changed since it was published."""
    stored = spark.read.parquet(f"{folder}/{DIGESTS}").select("file", F.col("sha256").alias("_stored"))
    now = file_digests(spark, folder).select("file", "sha256")
    both = stored.join(now, "file", "full_outer")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("_stored").isNull(), "added").when(F.col("sha256") != F.col("_stored"), "changed")
    return both.select("file", problem.alias("problem")).filter(F.col("problem").isNotNull())


def save_model(spark: SparkSession, model: QuantileForecaster, root: str, *, area: str, target: str, product: str) -> str:
    """Publish a model under its product and version; the folder is what deployments store as artifact URI."""
    folder = artifact_folder(root, area=area, target=target, product=product, version=model.model_version)
    return publish(spark, folder, lambda hidden: model.save(spark, hidden))


def load_model(spark: SparkSession, folder: str, *, check: bool = True) -> QuantileForecaster:
    """A published model; with ``check`` its files must be those that were published."""
    if not exists(spark, folder):
        raise FileNotFoundError(f"no artifact at {folder}")
    if check and (bad := damaged_files(spark, folder).head(1)):
        raise ValueError(f"artifact {folder}: {bad[0].file} is {bad[0].problem}")
    return QuantileForecaster.load(spark, folder)
