"""The catalog of detection signatures: YAML files -> validated definitions -> DataFrame.

A file holds one definition (signature, meta, detection, scoring, tuning) or a rule set: a
category, defaults and a mapping id -> short rule. A bad file is recorded, not fatal.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field, replace
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUILT_IN = Path(__file__).resolve().parent.parent / "rules"

# What the fields of a definition may hold.
CATEGORIES = ("prompt-injection", "content-safety", "data-leakage", "agentic", "system-prompt")
SEVERITIES = ("critical", "high", "medium", "low", "info")
LEVELS = ("high", "medium", "low")
ENGINES = ("heuristic", "classifier", "semantic", "llm-judge", "composite")
DIRECTIONS = ("input", "output", "bidirectional")
CONDITIONS = ("any", "all", "weighted")
ACTIONS = ("enforce", "monitor")
PATTERN_TYPES = ("regex", "substring", "semantic", "perplexity", "encoding", "unicode")
CONFIDENCE = {"high": 0.90, "medium": 0.70, "low": 0.45}
OTHER_CONFIDENCE = 0.70


@dataclass(frozen=True)
class Pattern:
    type: str
    value: str | None = None
    flags: str | None = None
    case_insensitive: bool | None = None
    reference_phrases: tuple[str, ...] | None = None
    similarity_threshold: float | None = None
    min_threshold: float | None = None
    max_threshold: float | None = None
    encodings: tuple[str, ...] | None = None
    checks: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Signature:
    id: str
    name: str
    version: str
    category: str
    subcategory: str
    technique: str
    severity: str
    confidence: str
    performance_cost: str
    engine: str
    direction: str
    condition: str
    anomaly_points: int
    enabled: bool
    default_enabled: bool
    default_action: str
    owasp_llm: str | None = None
    atlas: tuple[str, ...] | None = None
    tags: tuple[str, ...] | None = None
    model: str | None = None
    patterns: tuple[Pattern, ...] = field(default_factory=tuple)
    example: str | None = None

    @property
    def active(self) -> bool:
        return self.enabled and self.default_enabled

    @property
    def base_confidence(self) -> float:
        return CONFIDENCE.get(self.confidence, OTHER_CONFIDENCE)


def _need(data: dict, *names: str) -> list:
    out = []
    for name in names:
        if data.get(name) is None:
            raise ValueError(f"{name} is missing")
        out.append(data[name])
    return out


def _among(name: str, value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"{name} is {value!r}, not one of {', '.join(allowed)}")
    return value


def _words(value) -> tuple[str, ...] | None:
    return None if value is None else tuple(str(x) for x in value)


def parse_pattern(data: dict) -> Pattern:
    """A pattern; regex and substring patterns need a value that is not empty."""
    kind = _among("pattern type", data.get("type"), PATTERN_TYPES)
    if kind in ("regex", "substring") and not data.get("value"):
        raise ValueError(f"{kind} pattern without value")
    number = lambda k: None if data.get(k) is None else float(data[k])
    return Pattern(
        kind,
        data.get("value"),
        data.get("flags"),
        data.get("case_insensitive"),
        _words(data.get("reference_phrases")),
        number("similarity_threshold"),
        number("min_threshold"),
        number("max_threshold"),
        _words(data.get("encodings")),
        _words(data.get("checks")),
    )


def parse_signature(data: dict) -> Signature:
    """A definition in its long form; ValueError says what is wrong. Unknown keys are ignored."""
    if not isinstance(data, dict):
        raise ValueError("not a mapping")
    head, meta, detection, scoring, tuning = _need(data, "signature", "meta", "detection", "scoring", "tuning")
    ident, name, version = _need(head, "id", "name", "version")
    category, sub, technique, severity, confidence, cost = _need(meta, "category", "subcategory", "technique", "severity", "confidence", "performance_cost")
    engine, direction, condition = _need(detection, "engine", "direction", "condition")
    (points,) = _need(scoring, "anomaly_points")
    enabled, default_enabled, action = _need(tuning, "enabled", "default_enabled", "default_action")
    if isinstance(points, bool) or not isinstance(points, int) or not 1 <= points <= 15:
        raise ValueError("anomaly_points is not an integer from 1 to 15")
    return Signature(
        id=str(ident),
        name=str(name),
        version=str(version),
        category=_among("category", category, CATEGORIES),
        subcategory=str(sub),
        technique=str(technique),
        severity=_among("severity", severity, SEVERITIES),
        confidence=_among("confidence", confidence, LEVELS),
        performance_cost=_among("performance_cost", cost, LEVELS),
        engine=_among("engine", engine, ENGINES),
        direction=_among("direction", direction, DIRECTIONS),
        condition=_among("condition", condition, CONDITIONS),
        anomaly_points=points,
        enabled=bool(enabled),
        default_enabled=bool(default_enabled),
        default_action=_among("default_action", action, ACTIONS),
        owasp_llm=meta.get("owasp_llm"),
        atlas=_words(meta.get("atlas")),
        tags=_words(meta.get("tags")),
        model=detection.get("model"),
        patterns=tuple(parse_pattern(p) for p in detection.get("patterns") or ()),
        example=meta.get("example"),
    )


def expand_rules(data: dict) -> list[dict]:
    """The long forms of a rule set."""
    out = []
    for ident, rule in data["rules"].items():
        r = {**(data.get("defaults") or {}), **rule}
        patterns = [p if isinstance(p, dict) else {"type": "regex", "value": p} for p in r.get("patterns", [])]
        out.append(
            {
                "signature": {"id": ident, "name": r.get("name"), "version": r.get("version", "1.0.0")},
                "meta": {
                    "category": data["category"],
                    "subcategory": r.get("sub", "general"),
                    "technique": r.get("technique", r.get("sub", "general")),
                    "owasp_llm": r.get("owasp_llm"),
                    "atlas": r.get("atlas"),
                    "severity": r.get("severity"),
                    "confidence": r.get("confidence"),
                    "performance_cost": r.get("cost"),
                    "tags": r.get("tags"),
                    "example": r.get("example"),
                },
                "detection": {"engine": r.get("engine"), "direction": r.get("direction"), "condition": r.get("condition", "any"), "model": r.get("model"), "patterns": patterns},
                "scoring": {"anomaly_points": r.get("points")},
                "tuning": {"enabled": r.get("enabled", True), "default_enabled": r.get("default_enabled", True), "default_action": r.get("action", "enforce")},
            }
        )
    return out


@dataclass
class Catalog:
    """Signatures in order, and the files that could not be read as (file, kind, message)."""

    signatures: list[Signature] = field(default_factory=list)
    errors: list[tuple[str, str, str]] = field(default_factory=list)

    @classmethod
    def load(cls, folder: str | Path | None = None) -> Catalog:
        """All ``*.yaml`` and ``*.yml`` files below a folder, by path; FileNotFoundError without a folder."""
        if folder is None:
            built_in = _built_in()
            return cls(list(built_in.signatures), list(built_in.errors))
        root = Path(folder)
        if not root.is_dir():
            raise FileNotFoundError(root)
        out = cls()
        found: dict[str, Signature] = {}
        for path in sorted(p for p in root.rglob("*") if p.suffix in (".yaml", ".yml") and not p.name.startswith("LICENSE")):
            try:
                for data in yaml.safe_load_all(path.read_text(encoding="utf-8")):
                    for one in expand_rules(data) if isinstance(data, dict) and "rules" in data else [data]:
                        signature = parse_signature(one)
                        found[signature.id] = signature
            except yaml.YAMLError as e:
                out.errors.append((str(path), "yaml", str(e)))
            except (ValueError, KeyError, TypeError, AttributeError) as e:
                out.errors.append((str(path), "schema", str(e)))
        out.signatures = list(found.values())
        return out

    @classmethod
    def layered(cls, custom: str | Path | None = None, base: str | Path | None = None) -> Catalog:
        """The base catalog with a custom folder over it: equal ids are replaced in place, new ones come last.

        A custom folder that does not exist adds nothing.
        """
        out = cls.load(base)
        if custom and Path(custom).is_dir():
            over = cls.load(custom)
            merged = {s.id: s for s in out.signatures}
            merged.update({s.id: s for s in over.signatures})
            out = cls(list(merged.values()), out.errors + over.errors)
        return out

    def get(self, ident: str) -> Signature | None:
        return next((s for s in self.signatures if s.id == ident), None)

    def detail(self, ident: str) -> tuple[int, dict | None]:
        """(200, the sixteen fields of a signature), or (404, None) for an unknown id."""
        s = self.get(ident)
        if s is None:
            return 404, None
        names = ("id", "name", "version", "category", "engine", "severity", "direction", "anomaly_points", "subcategory", "technique", "confidence", "performance_cost", "condition", "default_action")
        return 200, {n: getattr(s, n) for n in names} | {"enabled": s.default_enabled, "tags": list(s.tags or ())}

    def ids(self) -> list[str]:
        return [s.id for s in self.signatures]

    def by_engine(self) -> dict[str, list[Signature]]:
        out: dict[str, list[Signature]] = {}
        for s in self.signatures:
            out.setdefault(s.engine, []).append(s)
        return out

    def active(self, direction: str) -> list[Signature]:
        """Enabled signatures for a direction."""
        return [s for s in self.signatures if s.active and s.direction in (direction, "bidirectional")]

    def with_signature(self, signature: Signature, **changes) -> Catalog:
        """A copy with one signature changed."""
        return Catalog([replace(s, **changes) if s.id == signature.id else s for s in self.signatures], self.errors)

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per signature, in order (``ord``), with its patterns."""
        text = "id string, name string, version string, category string, subcategory string, technique string, severity string, confidence string, performance_cost string, engine string, direction string, condition string, anomaly_points int, enabled boolean, default_enabled boolean, default_action string, owasp_llm string, atlas array<string>, tags array<string>, model string"
        pattern = "patterns array<struct<type:string,value:string,flags:string,case_insensitive:boolean,reference_phrases:array<string>,similarity_threshold:double,min_threshold:double,max_threshold:double,encodings:array<string>,checks:array<string>>>"
        names = [x.split()[0] for x in text.split(", ")]
        rows = []
        for i, s in enumerate(self.signatures):
            values = [list(v) if isinstance(v := getattr(s, n), tuple) else v for n in names]
            patterns = [tuple(list(v) if isinstance(v, tuple) else v for v in vars(p).values()) for p in s.patterns]
            rows.append((*values, patterns, i))
        return spark.createDataFrame(rows, f"{text}, {pattern}, ord int")

    def errors_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.errors, "file string, kind string, message string")

    def listing(self, spark: SparkSession) -> DataFrame:
        """The short listing; ``enabled`` is the default state."""
        return self.frame(spark).orderBy("ord").select("id", "name", "category", "severity", "engine", "direction", "anomaly_points", "default_action", F.col("default_enabled").alias("enabled"))


@functools.lru_cache(maxsize=1)
def _built_in() -> Catalog:
    return Catalog.load(BUILT_IN)


def merge_layers(base: DataFrame, over: DataFrame, key: str = "signature_id") -> DataFrame:
    """Layers as tables: rows of ``over`` replace the rows of ``base`` with their key.

    Null keys match nothing, so such rows of both are kept.
    """
    return base.join(over.select(key).distinct(), key, "left_anti").unionByName(over, allowMissingColumns=True)
