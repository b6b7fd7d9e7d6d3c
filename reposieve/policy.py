"""Audit policy: which hosts, paths and action pins are acceptable."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Policy:
    block_private: bool = True
    allowed_domains: tuple[str, ...] = ("api.github.com", "slack.com")
    safe_root: str = "/workspace"
    require_pinned: bool = True
    require_sha_pin: bool = False

    @classmethod
    def from_dict(cls, doc: dict | None) -> "Policy":
        """Policy from a parsed policy document: a value that is missing or empty is that of ``NEUTRAL``."""
        given = {}
        for name, (section, key) in _PLACES.items():
            value, kind = ((doc or {}).get(section) or {}).get(key), type(NEUTRAL[name])
            given[name] = NEUTRAL[name] if value is None else kind(value)
        return cls(**given)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "Policy":
        """Policy from a YAML or JSON document in any store that Spark reads."""
        import yaml

        # A configuration file: it becomes literals of the plan.
        return cls.from_dict(yaml.safe_load("\n---\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())))


#: Where a policy document has each value, and what holds where it has none.
_PLACES = {
    "block_private": ("network", "block_private"), "allowed_domains": ("network", "allowed_domains"),
    "safe_root": ("filesystem", "safe_root"),
    "require_pinned": ("ci", "require_pinned"), "require_sha_pin": ("ci", "require_sha_pin"),
}
NEUTRAL = {f.name: f.default for f in fields(Policy)} | {"allowed_domains": ()}
