"""Policy profiles: thresholds, mode, and overrides of actions and points."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.operators.scoring import ScoringPolicy

MODES = ("enforce", "monitor")
OVERRIDES = ("default", "enforce", "monitor")


@dataclass(frozen=True)
class Policy:
    """A profile. An override's action other than default wins over the mode, the mode over the signature."""

    name: str = "default"
    version: str = "1.0.0"
    mode: str = "enforce"
    scoring: ScoringPolicy = field(default_factory=ScoringPolicy)
    early_exit: float = 13.0
    actions: dict[str, str] = field(default_factory=dict)
    points: dict[str, int] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, data: dict) -> Policy:
        mode = data.get("mode", "enforce")
        if mode not in MODES:
            raise ValueError(f"mode is {mode!r}")
        t = data["thresholds"]
        actions, points = {}, {}
        for ident, o in (data.get("signatures") or {}).items():
            action = o.get("action", "default")
            if action not in OVERRIDES:
                raise ValueError(f"action of {ident} is {action!r}")
            actions[ident] = action
            if o.get("anomaly_points") is not None:
                points[ident] = int(o["anomaly_points"])
        scoring = ScoringPolicy(*(float(t[k]) for k in ("inbound_flag", "inbound_block", "outbound_flag", "outbound_block")))
        return cls(data["name"], str(data.get("version", "1.0.0")), mode, scoring, float(t.get("early_exit", 13.0)), actions, points)

    @classmethod
    def from_yaml(cls, path: str | Path) -> Policy:
        return cls.from_dict(yaml.safe_load(Path(path).read_text(encoding="utf-8")))

    @property
    def monitor(self) -> bool:
        return self.mode == "monitor"

    def action(self, ident: str, default: str) -> str:
        own = self.actions.get(ident, "default")
        return own if own != "default" else "monitor" if self.monitor else default

    def points_of(self, ident: str, default: int) -> int:
        return self.points.get(ident, default)


DEFAULT = Policy()
STRICT = Policy("strict", scoring=ScoringPolicy(2.5, 7.0, 2.0, 5.0), early_exit=10.0)
MONITOR_ONLY = Policy("monitor-only", mode="monitor", scoring=ScoringPolicy(5.0, 15.0, 5.0, 10.0), early_exit=25.0)
PROFILES = {p.name: p for p in (DEFAULT, STRICT, MONITOR_ONLY)}


def resolve(explicit: str | Path | None = None, folder: str | Path | None = None) -> Policy:
    """The policy at a path if it exists, else the first file of a folder, else the default profile."""
    if explicit and Path(explicit).is_file():
        return Policy.from_yaml(explicit)
    if folder and Path(folder).is_dir():
        for path in sorted(p for p in Path(folder).iterdir() if p.suffix in (".yaml", ".yml")):
            return Policy.from_yaml(path)
    return DEFAULT


def apply_overrides(hits: DataFrame, overrides: DataFrame, monitor: bool = False) -> DataFrame:
    """Add ``action`` and ``points`` to rows with signature_id, default_action, anomaly_points.

    ``overrides`` (signature_id unique, override_action, override_points) is a small table and
    left-joined; hits without an override keep the mode's or their own values.
    """
    own = F.col("override_action")
    action: Column = F.when(own.isNotNull() & (own != "default"), own)
    action = action.otherwise(F.lit("monitor") if monitor else F.col("default_action"))
    joined = hits.join(overrides, "signature_id", "left")
    return joined.withColumn("action", action).withColumn("points", F.coalesce("override_points", "anomaly_points")).drop("override_action", "override_points")
