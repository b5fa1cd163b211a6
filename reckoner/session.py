"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Runtime SQL settings: safe to apply to a session somebody else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that workers can import it from any folder."""
    context = spark.sparkContext
    if getattr(context, "_reckoner_shipped", False):
        return spark
    archive = os.path.join(tempfile.mkdtemp(prefix="reckoner-package-"), "reckoner.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(_PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE)))
    context.addPyFile(archive)
    context._reckoner_shipped = True
    return spark


def build_session(app: str = "reckoner", master: str | None = None, **conf: str) -> SparkSession:
    """Create or fetch a session. On a cluster leave ``master`` unset and let the submitter decide."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return apply_runtime_conf(builder.getOrCreate())
