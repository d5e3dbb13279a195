"""Settings of ingestion; a session can override each as atlasgraph.<name>."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    exclude_dirs: tuple[str, ...] = ("tests", "migrations", ".git", "__pycache__", ".pytest_cache", ".venv", "node_modules")
    src_roots: tuple[str, ...] = ("src",)
    endpoint_patterns: tuple[str, ...] = (r"^(app|router)\.(get|post|put|delete|patch|websocket)$",)
    semantic_batch_size: int = 20
    semantic_confidence_min: float = 0.6
    output_dir: str = "output"

    @classmethod
    def of(cls, spark: SparkSession) -> "Settings":
        """Defaults, with what the session sets (lists separated by commas)."""
        out = cls()
        for f in fields(cls):
            value = spark.conf.get(f"atlasgraph.{f.name}", None)
            if value is not None:
                kind = type(getattr(out, f.name))
                out = replace(out, **{f.name: tuple(v for v in value.split(",") if v) if kind is tuple else kind(value)})
        return out
