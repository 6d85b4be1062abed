"""Session settings with typed defaults (SC15)."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (type, default); set in a session as tabulon.<name>.
DEFAULTS: dict[str, tuple[type, object]] = {
    "session.ttl.minutes": (int, 180),
    "engine.idle.seconds": (int, 90),
    "quota.flash.per.day": (int, 20),
    "quota.lite.per.day": (int, 500),
    "rate.flash.per.minute": (int, 10),
    "rate.lite.per.minute": (int, 15),
    "quota.zone": (str, "America/Los_Angeles"),
    "shown.zone": (str, "Asia/Tehran"),
    "trust.after": (int, 2),
    "general.after": (int, 20),
    "local.only": (bool, False),
}


def setting(spark: SparkSession, name: str):
    """The session's value of a setting, typed; its default where unset or unreadable."""
    kind, default = DEFAULTS[name]
    raw = spark.conf.get(f"tabulon.{name}", None)
    if raw is None or not raw.strip():
        return default
    if kind is bool:
        return raw.strip().lower() in {"1", "true", "yes", "on"}
    try:
        return kind(raw.strip())
    except ValueError:
        return default


def session(app: str = "tabulon", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
