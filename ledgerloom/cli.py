"""Command line: ``python -m ledgerloom.cli COMMAND FOLDER ...``; JSON out, exit 0 or 2.

``init FOLDER SOURCE``, ``status``, ``doctor``, ``run``, ``resume``, ``collect FOLDER DESTINATION`` and
``translate FOLDER SOURCE DESTINATION`` (bind, run, collect).  Services are named as ``module:function``, a
function without arguments that returns :class:`ledgerloom.plans.kernel.Services`.
"""

from __future__ import annotations

import argparse
import importlib
import json
import re
import sys
from pathlib import Path

from .functions.text import SECRETS
from .plans.project import Config, ControlError, Project

COMMANDS = ("init", "status", "doctor", "run", "resume", "collect", "translate")


def _clean(message: str) -> str:
    for pattern in SECRETS:
        message = re.sub(pattern, "[REDACTED]", message[:2000])
    return message


def _run(project: Project, services: str | None, again: bool) -> dict:
    """A run from the bound inputs only; ``again`` demands that one was begun before."""
    from pyspark.sql import SparkSession

    from .plans import publication

    if not services:
        raise ControlError("a run needs services")
    source, config = project.inputs()
    tables = project.folder / "tables"
    if again and not tables.exists():
        raise ControlError("there is no run to resume")
    module, _, name = services.partition(":")
    spark = SparkSession.builder.getOrCreate()
    services_ = getattr(importlib.import_module(module), name)()
    made = publication.wire(spark, f"file://{tables.resolve()}", project, config, services_)
    result = made.run(publication.read_source(spark, str(Path(source).resolve())))
    return {"state": project.status(), "release": result.release, "calls": sum(made.executor.calls.values())}


def perform(command: str, folder: str, source: str | None = None, destination: str | None = None, config: str | None = None, services: str | None = None) -> object:
    """What a command returns; raises what :func:`main` reports."""
    project = Project(folder)
    if command in ("init", "translate"):
        if not source:
            raise ControlError("a source is missing")
        bound = project.init(source, Config.load(config) if config else None)
    if command == "init":
        return bound
    if command == "status":
        return {"state": project.status()}
    if command == "doctor":
        return dict(project.doctor())
    if command in ("run", "resume"):
        return _run(project, services, command == "resume")
    if not destination:
        raise ControlError("a destination is missing")
    if command == "translate":
        return _run(project, services, False) | {"files": project.collect(destination)}
    return project.collect(destination)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerloom")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = sub.add_parser(name)
        p.add_argument("folder")
        if name in ("init", "translate"):
            p.add_argument("source")
            p.add_argument("--config")
        if name in ("collect", "translate"):
            p.add_argument("destination")
        if name in ("run", "resume", "translate"):
            p.add_argument("--services", required=True)
    try:
        out = perform(**vars(parser.parse_args(argv)))
    except (OSError, ValueError, RuntimeError) as e:
        print(json.dumps({"error": _clean(str(e))}), file=sys.stderr)
        return 2
    print(json.dumps(out, sort_keys=True))
    return 0


if __name__ == "__main__":
    sys.exit(main())
