"""Single calls, health and keys, for use behind any web server; and the command line."""

from __future__ import annotations

import argparse
import hmac
import json
import os
import secrets
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward import __version__
from textward.plans.scan import Scanner, response


def health(scanner: Scanner) -> dict:
    """State of a scanner: ready if it has signatures."""
    n = len(scanner.catalog.signatures)
    return {"status": "ok" if n else "not ready", "version": __version__, "signatures": n, "policy": scanner.policy.name}


def scan_one(spark: SparkSession, scanner: Scanner, text: str, direction: str = "input", request_id: str = "") -> dict:
    """Decision, score and matches of one text."""
    row = response(scanner.scan(spark.createDataFrame([(request_id, text)], "request_id string, text string"), direction), "request_id").first()
    return {"decision": row.decision, "score": row.score, "matches": [m.asDict() for m in row.matches], "request_id": row.request_id}


def authorise(header: str | None, scan_key: str | None, admin_key: str | None, admin: bool = False) -> tuple[int, str | None]:
    """(status, role) of an Authorization header: 200, 401 without a right key, 403 for a scan key where an admin key is needed.

    With no key configured scanning is open; administration never is.
    """
    if not admin and not scan_key and not admin_key:
        return 200, None
    token = header[7:] if header and header.startswith("Bearer ") else None
    if token is None:
        return 401, None
    if admin_key and hmac.compare_digest(token, admin_key):
        return 200, "admin"
    if scan_key and hmac.compare_digest(token, scan_key):
        return (403, "scan") if admin else (200, "scan")
    return 401, None


def generate_keys() -> dict[str, str]:
    return {"scan": f"twk_{secrets.token_urlsafe(24)}", "admin": f"twa_{secrets.token_urlsafe(24)}"}


def body_text(body) -> F.Column:
    """The text of a JSON request body: prompt, else message, else text."""
    return F.coalesce(*[F.get_json_object(body, f"$.{name}") for name in ("prompt", "message", "text")])


def http_status(decision, direction: str, block_on_flag: bool = False) -> F.Column:
    """403 for a blocked input, 451 for a blocked output, else 200."""
    stop = F.col(decision).isin("block", "flag") if block_on_flag else F.col(decision) == "block"
    return F.when(stop, 403 if direction == "input" else 451).otherwise(200)


def scan_path(spark: SparkSession, scanner: Scanner, path: str, fmt: str, direction: str) -> DataFrame:
    return scanner.scan(spark.read.format(fmt).load(path), direction)


#: Engines of each profile, beside the heuristic one.
PROFILES = {"lite": (), "standard": ("classifier", "semantic"), "full": ("classifier", "semantic", "llm-judge")}


def profile(name: str, folder: str = "models") -> Scanner:
    """A scanner with the classifiers of a profile that lie in a local folder; other engines need a model given in code."""
    scanner = Scanner()
    if "classifier" in PROFILES[name]:
        from textward.operators.engines import OnnxClassifier, classifier_engine

        found = {m: OnnxClassifier(f"{folder}/{m}") for m in ("injection", "toxicity") if OnnxClassifier.available(f"{folder}/{m}")}
        if found:
            scanner.engines["classifier"] = classifier_engine(found)
    return scanner


def model_status(folder: str) -> list[dict]:
    """Name and presence of each model of the profiles."""
    from textward.operators.engines import OnnxClassifier

    return [{"model": m, "present": OnnxClassifier.available(f"{folder}/{m}")} for m in ("injection", "toxicity")]


def setup(path: str | None) -> int:
    """Make keys; written to a file only its owner can read, which must not exist yet, or shown."""
    keys = generate_keys()
    if not path:
        print(json.dumps(keys))
        return 0
    try:
        handle = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
    except FileExistsError:
        print("the file exists; nothing was changed", file=sys.stderr)
        return 1
    with os.fdopen(handle, "w") as out:
        json.dump(keys, out)
    return 0


def main(argv: list[str] | None = None) -> int:
    from textward.session import local_session

    parser = argparse.ArgumentParser(prog="textward")
    commands = parser.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", help="scan a text or a table")
    scan.add_argument("--text")
    scan.add_argument("--path")
    scan.add_argument("--format", default="parquet")
    scan.add_argument("--out")
    scan.add_argument("--direction", default="input", choices=["input", "output"])
    test = commands.add_parser("test", help="scan a text under a profile")
    test.add_argument("text")
    test.add_argument("--direction", default="input", choices=["input", "output"])
    test.add_argument("--profile", default="lite", choices=sorted(PROFILES))
    commands.add_parser("signatures", help="list the signatures").add_argument("--id")
    listed = commands.add_parser("models", help="the models and which of them are in the local folder")
    listed.add_argument("what", choices=["list", "status"])
    listed.add_argument("--folder", default="models")
    admin = commands.add_parser("admin", help="set up keys")
    admin.add_argument("what", choices=["setup"])
    admin.add_argument("--file")
    commands.add_parser("keys", help="generate keys")
    args = parser.parse_args(argv)
    if args.command == "keys":
        print(json.dumps(generate_keys()))
        return 0
    if args.command == "admin":
        return setup(args.file)
    if args.command == "models":
        print(json.dumps(model_status(args.folder), indent=1))
        return 0
    scanner = Scanner()
    if args.command == "signatures" and args.id:
        status, found = scanner.catalog.detail(args.id)
        print(json.dumps(found))
        return 0 if status == 200 else 1
    if args.command == "signatures":
        for s in scanner.catalog.signatures:
            print(s.id, s.engine, s.direction, s.anomaly_points, s.name, sep="\t")
        return 0
    spark = local_session()
    if args.command == "test":
        print(json.dumps(scan_one(spark, profile(args.profile), args.text, args.direction)))
    elif args.text is not None:
        print(json.dumps(scan_one(spark, scanner, args.text, args.direction)))
    elif args.path and args.out:
        scan_path(spark, scanner, args.path, args.format, args.direction).write.parquet(args.out)
    else:
        parser.error("scan needs --text, or --path and --out")
    return 0
