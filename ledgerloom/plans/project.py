"""Projects on disk: bound inputs, configuration, atomic pointers, status, delivery.

Everything here is driver-side control: small JSON files, written to a temporary name and moved
into place.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import sys
import tempfile
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

SCHEMA_VERSION = 2

#: What each older version of the control manifest lacks; migrations only add.
MIGRATIONS = {1: {"parts": ["main"]}}


class ControlError(ValueError):
    """Inputs or files of a project are not what they were bound to."""


#: Roles that may have a model of their own.
ROLES = ("planner", "researcher", "translator", "reviewer", "adjudicator", "editor", "verifier", "document_reviewer")


@dataclass(frozen=True)
class Config:
    """Limits and names of a run; unknown or wrongly typed fields are refused."""

    source_language: str = "en"
    target_language: str = "zh-hans"
    profile_name: str = "publication"
    provider: str = "injected"
    endpoint: str = "https://localhost"
    api_key_env: str = "LEDGERLOOM_API_KEY"
    default_model: str = "default"
    role_models: dict = field(default_factory=dict)
    reasoning_effort: str = "high"
    request_timeout_seconds: int = 300
    enable_web_research: bool = True
    max_planning_calls: int = 500
    max_calls: int = 100_000
    max_tokens: int = 1_000_000_000
    max_cost: int = 1_000_000_000
    max_attempts: int = 3
    chunk_characters: int = 40_000
    context_before: int = 4
    context_after: int = 4
    context_characters: int = 6000

    @classmethod
    def load(cls, path: str | os.PathLike) -> Config:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
        if not isinstance(raw, dict):
            raise ControlError("configuration must be an object")
        known = {f.name: f.type for f in fields(cls)}
        if extra := set(raw) - set(known):
            raise ControlError(f"unknown fields: {sorted(extra)}")
        for name, value in raw.items():
            if type(value).__name__ != known[name]:
                raise ControlError(f"{name} must be {known[name]}")
        out = cls(**raw)
        if not out.endpoint.startswith("https://"):
            raise ControlError("endpoint must use https")
        if out.reasoning_effort not in ("low", "medium", "high"):
            raise ControlError("reasoning_effort must be low, medium or high")
        if set(out.role_models) - set(ROLES) or not all(isinstance(m, str) and m.strip() for m in out.role_models.values()):
            raise ControlError("role_models must name models of known roles")
        if not all(getattr(out, n).strip() for n in ("source_language", "target_language", "profile_name", "provider", "api_key_env", "default_model")):
            raise ControlError("names must not be blank")
        limits = (out.chunk_characters, out.max_attempts, out.max_planning_calls, out.max_calls, out.max_tokens, out.max_cost, out.request_timeout_seconds, out.context_characters)
        if min(out.context_before, out.context_after) < 0 or min(limits) < 1:
            raise ControlError("limits must be positive")
        return out


def sha256_file(path: str | os.PathLike, step: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(step):
            h.update(block)
    return h.hexdigest()


def write_atomic(path: Path, data: bytes) -> None:
    """Temporary file, flush to disk, rename: readers see the old or the new content."""
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    except BaseException:
        Path(tmp).unlink(missing_ok=True)
        raise


def _json(value: object) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


class Project:
    """A project folder: ``control.json``, bound inputs, pointers per part."""

    def __init__(self, folder: str | os.PathLike):
        self.folder = Path(folder)

    @property
    def _control(self) -> Path:
        return self.folder / "control.json"

    def init(self, source: str | os.PathLike, config: Config | None = None) -> dict:
        """Binds the source and configuration by digest; a second call with the same inputs changes nothing."""
        config = config or Config()
        manifest = {"schema_version": SCHEMA_VERSION, "source_name": Path(source).name, "source_sha256": sha256_file(source), "source_size": os.path.getsize(source), "config_sha256": hashlib.sha256(_json(asdict(config))).hexdigest(), "parts": ["main"]}
        if self._control.exists():
            if self.manifest() != manifest:
                raise ControlError("project is bound to other inputs")
            return manifest
        self.folder.mkdir(parents=True, exist_ok=True)
        inputs = self.folder / "inputs"
        inputs.mkdir(exist_ok=True)
        shutil.copyfile(source, inputs / manifest["source_name"])
        write_atomic(inputs / "config.json", _json(asdict(config)))
        write_atomic(self._control, _json(manifest))
        return manifest

    def manifest(self) -> dict:
        """The bound manifest: exact fields, exact types, files unchanged."""
        raw = json.loads(self._control.read_text())
        version = raw.get("schema_version") if isinstance(raw, dict) else None
        if type(version) is not int or version < 1:
            raise ControlError("control manifest has wrong fields")
        if version > SCHEMA_VERSION:
            raise ControlError("project was written by a newer version")
        if version < SCHEMA_VERSION:
            for v in range(version, SCHEMA_VERSION):
                raw = MIGRATIONS[v] | raw | {"schema_version": v + 1}
            write_atomic(self._control, _json(raw))
        want = {"schema_version": int, "source_name": str, "source_sha256": str, "source_size": int, "config_sha256": str, "parts": list}
        if set(raw) != set(want) or any(type(raw[k]) is not t for k, t in want.items()):
            raise ControlError("control manifest has wrong fields")
        for name, digest in ((raw["source_name"], raw["source_sha256"]), ("config.json", raw["config_sha256"])):
            if sha256_file(self.folder / "inputs" / name) != digest:
                raise ControlError(f"{name} changed after it was bound")
        return raw

    def inputs(self) -> tuple[Path, Config]:
        """Run arguments, rebuilt from the bound files only."""
        m = self.manifest()
        return self.folder / "inputs" / m["source_name"], Config.load(self.folder / "inputs" / "config.json")

    def point(self, kind: str, part: str, target: dict) -> None:
        """Makes ``target`` the active release or artifact of a part, atomically."""
        write_atomic(self.folder / "active" / f"{kind}-{part}.json", _json(target))

    def active(self, kind: str, part: str) -> dict | None:
        path = self.folder / "active" / f"{kind}-{part}.json"
        return json.loads(path.read_text()) if path.exists() else None

    def record_report(self, part: str, report: dict) -> bool:
        """Keeps a report for good; only a passing one becomes the active artifact."""
        path = self.folder / "reports" / f"{report['report_id']}.json"
        data = _json(report)
        if path.exists() and path.read_bytes() != data:
            raise ControlError("a different report has this id")
        write_atomic(path, data)
        if report["verdict"] == "PASS":
            self.point("artifact", part, {"report_id": report["report_id"], "sha256": report["target_sha256"]})
        return report["verdict"] == "PASS"

    def release(self, part: str, payload: bytes, report: dict, state: dict) -> bool:
        """Final file, report, pointer and output report as one step; whether the report passes.

        What is to be done is written down first, in one file that appears at once.  A crash before that
        changes nothing; after it, whoever looks at the project next does the rest (:meth:`recover`).
        """
        self.recover()
        done = self.folder / "reports" / f"{report['report_id']}.json"
        if done.exists() and done.read_bytes() != _json(report):
            raise ControlError("a different report has this id")
        write_atomic(self.folder / "journal" / f"{part}.json", _json({"part": part, "payload": payload.decode("utf-8"), "report": report, "state": state}))
        self.recover()
        return report["verdict"] == "PASS"

    def recover(self) -> None:
        """Does what a journal says and then removes it; doing it twice changes nothing."""
        journals = self.folder / "journal"
        for path in sorted(journals.glob("*.json")) if journals.exists() else ():
            step = json.loads(path.read_text(encoding="utf-8"))
            if step["report"]["verdict"] == "PASS":
                self.publish(step["part"], step["payload"].encode("utf-8"))
            self.record_report(step["part"], step["report"])
            write_atomic(self.folder / "output" / "verification-report.json", _json(step["state"]) + b"\n")
            path.unlink()

    def status(self, part: str = "main", units: int = 0) -> str:
        """State by precedence; a broken binding or a changed artifact blocks."""
        self.recover()
        try:
            self.manifest()
        except FileNotFoundError:
            return "NEW"
        except ControlError:
            return "BLOCKED"
        if (a := self.active("artifact", part)) is not None:
            final = self.folder / "final" / part
            return "RELEASED" if final.exists() and sha256_file(final) == a["sha256"] else "BLOCKED"
        if any((self.folder / "reports").glob("*.json")) if (self.folder / "reports").exists() else False:
            return "BLOCKED"
        if self.active("release", part) is not None:
            return "VERIFYING"
        return "IN_PROGRESS" if units else "NEW"

    def doctor(self, least_free: int = 1 << 30) -> list[tuple[str, str]]:
        """Preflight checks as (name, PASS, WARN or BLOCK): what a run needs, without starting one."""
        out = [("python", "PASS" if sys.version_info >= (3, 10) else "BLOCK"), ("java", "PASS" if os.environ.get("JAVA_HOME") or shutil.which("java") else "BLOCK")]
        config = None
        for name, check in (("control", self.manifest), ("inputs", self.inputs)):
            try:
                config = check()
                out.append((name, "PASS"))
            except (OSError, ValueError):
                config = None
                out.append((name, "BLOCK"))
        there = next(p for p in (self.folder, *self.folder.resolve().parents) if p.exists())
        out.append(("location", "PASS" if os.access(there, os.W_OK) else "BLOCK"))
        if config is not None and config[1].provider != "injected":
            out.append(("credential", "PASS" if os.environ.get(config[1].api_key_env) else "BLOCK"))
        free = shutil.disk_usage(there).free
        out.append(("disk", "PASS" if free > least_free else "WARN"))
        return out

    def publish(self, part: str, payload: bytes) -> str:
        path = self.folder / "final" / part
        write_atomic(path, payload)
        return hashlib.sha256(payload).hexdigest()

    def collect(self, destination: str | os.PathLike, part: str = "main") -> list[dict]:
        """Copies the released file and lists name, digest and size; refuses any other state."""
        if self.status(part) != "RELEASED":
            raise ControlError("only a released project can be collected")
        out = Path(destination)
        out.mkdir(parents=True, exist_ok=True)
        data = (self.folder / "final" / part).read_bytes()
        target = out / part
        if target.exists() and target.read_bytes() != data:
            raise ControlError("destination holds another file")
        write_atomic(target, data)
        return [{"name": part, "sha256": hashlib.sha256(data).hexdigest(), "size": len(data)}]
