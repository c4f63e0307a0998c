"""The commands as tools of a JSON-RPC 2.0 server on standard input and output, a message a line.

Runs take long, so ``run``, ``resume`` and ``translate`` start a detached process and return at once; the
tool ``status`` tells how it goes.
"""

from __future__ import annotations

import json
import os
import subprocess
import sys
import time
from pathlib import Path
from typing import TextIO

from . import __name__ as PACKAGE
from .cli import COMMANDS, _clean, perform
from .plans.project import ControlError, write_atomic

PROTOCOL = "2024-11-05"
DETACHED = ("run", "resume", "translate")
FIELDS = ("folder", "source", "destination", "config", "services")
NEEDS = {"init": ("source",), "collect": ("destination",), "run": ("services",), "resume": ("services",), "translate": ("source", "destination", "services")}


def start(command: str, arguments: dict) -> dict:
    """Starts a command as a process of its own, one a folder at a time; its state is kept in the folder."""
    folder = Path(arguments["folder"])
    if poll(folder).get("job") == "running":
        raise ControlError("a job runs in this folder")
    folder.mkdir(parents=True, exist_ok=True)
    positional = [arguments[k] for k in ("folder", "source", "destination") if arguments.get(k)]
    options = [x for k in ("config", "services") if arguments.get(k) for x in (f"--{k}", arguments[k])]
    with open(folder / "job.out", "wb") as out, open(folder / "job.err", "wb") as err:
        p = subprocess.Popen([sys.executable, "-m", f"{PACKAGE}.cli", command, *positional, *options], stdin=subprocess.DEVNULL, stdout=out, stderr=err, start_new_session=True)
    write_atomic(folder / "job.json", json.dumps({"pid": p.pid, "command": command, "started": time.time()}).encode())
    return {"job": "running", "command": command, "pid": p.pid}


def poll(folder: str | os.PathLike) -> dict:
    """How the last job of a folder goes: running, done with its result, or failed with its message."""
    folder = Path(folder)
    if not (folder / "job.json").exists():
        return {}
    job = json.loads((folder / "job.json").read_text())
    try:
        if os.waitpid(job["pid"], os.WNOHANG) == (0, 0):
            return {"job": "running", "command": job["command"]}
    except ChildProcessError:  # another process started it, or it was waited for
        try:
            os.kill(job["pid"], 0)
            return {"job": "running", "command": job["command"]}
        except (ProcessLookupError, PermissionError):
            pass
    lines = (folder / "job.out").read_text().strip().splitlines()
    if lines:
        return {"job": "done", "command": job["command"], "result": json.loads(lines[-1])}
    errors = (folder / "job.err").read_text().strip().splitlines()
    return {"job": "failed", "command": job["command"], "error": _clean(errors[-1] if errors else "no output")}


def call(name: str, arguments: dict) -> object:
    """One tool call."""
    if name not in COMMANDS:
        raise ControlError(f"unknown tool {name}")
    if set(arguments) - set(FIELDS) or not all(isinstance(v, str) for v in arguments.values()):
        raise ControlError("unknown or wrongly typed arguments")
    if missing := [k for k in ("folder", *NEEDS.get(name, ())) if not arguments.get(k)]:
        raise ControlError(f"missing: {', '.join(missing)}")
    if name in DETACHED:
        return start(name, arguments)
    out = perform(name, **arguments)
    return out | poll(arguments["folder"]) if name == "status" else out


def handle(message: dict) -> dict | None:
    """The answer to a message; none to a notification."""
    method, number = message.get("method"), message.get("id")
    if number is None:
        return None
    answer = {"jsonrpc": "2.0", "id": number}
    if method == "initialize":
        return answer | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": PACKAGE, "version": "1"}}}
    if method == "ping":
        return answer | {"result": {}}
    if method == "tools/list":
        shape = lambda c: {"type": "object", "properties": {f: {"type": "string"} for f in FIELDS}, "required": ["folder", *NEEDS.get(c, ())]}
        return answer | {"result": {"tools": [{"name": c, "description": f"The command {c}.", "inputSchema": shape(c)} for c in COMMANDS]}}
    if method == "tools/call":
        params = message.get("params") or {}
        try:
            text, failed = json.dumps(call(params.get("name", ""), params.get("arguments") or {}), sort_keys=True), False
        except (OSError, ValueError, RuntimeError) as e:
            text, failed = _clean(str(e)), True
        return answer | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
    return answer | {"error": {"code": -32601, "message": "unknown method"}}


def serve(lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            reply = handle(message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}}
        except json.JSONDecodeError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            out.write(json.dumps(reply, sort_keys=True) + "\n")
            out.flush()


if __name__ == "__main__":
    serve()
