"""Registry of the models the profiles use, and digests of local model files."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Profiles from small to large; each has the models of those before it.
PROFILES = ("lite", "standard", "full")


@dataclass(frozen=True)
class Model:
    name: str
    task: str
    profile: str
    size_mb: int


MODELS = (
    Model("injection", "prompt injection classifier", "standard", 400),
    Model("toxicity", "toxicity classifier", "standard", 520),
    Model("embedding", "sentence embedding", "standard", 80),
    Model("judge", "language model judge", "full", 2400),
)


def models_for(profile: str) -> list[Model]:
    """Models of a profile; an unknown profile has none."""
    if profile not in PROFILES:
        return []
    return [m for m in MODELS if PROFILES.index(m.profile) <= PROFILES.index(profile)]


def model(name: str) -> Model | None:
    return next((m for m in MODELS if m.name == name), None)


def present(folder: str | Path) -> list[str]:
    """Names of the models whose files lie in a local folder."""
    return [m.name for m in MODELS if (Path(folder) / m.name).is_dir() and any((Path(folder) / m.name).iterdir())]


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """path, sha256 of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"))
