"""Spark session settings the package relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Times are written and read in UTC; adaptive plans pick joins by measured sizes;
# checkpoints are removed once nothing refers to them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# Wide text projections grow generated methods past the 8000 bytes of bytecode
# that the JVM compiles; below this limit Spark splits them into smaller ones.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
METHOD_LIMIT_DEFAULT = "65535"
METHOD_LIMIT_COMPILED = "8000"


def tune(spark: SparkSession) -> SparkSession:
    """Set the options that may change while a session runs, unless already chosen."""
    if spark.conf.get(METHOD_LIMIT, METHOD_LIMIT_DEFAULT) == METHOD_LIMIT_DEFAULT:
        spark.conf.set(METHOD_LIMIT, METHOD_LIMIT_COMPILED)
    return spark


def build_session(
    app: str = "tablekit", master: str | None = None, settings: dict[str, str] | None = None
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **(settings or {})}.items():
        builder = builder.config(name, value)
    return tune(builder.getOrCreate())
