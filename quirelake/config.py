"""Local configuration: a JSON file, written atomically, and its precedence."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

SCHEMA_VERSION = 3
#: fields that name one model: given together or not at all
IDENTITY = ("model_id", "model_path", "model_sha256")


class ConfigError(ValueError):
    pass


def load(path: str) -> dict:
    """The configuration; {} if there is none. Schema versions 1 to 3 are read."""
    file = Path(path)
    if not file.exists():
        return {}
    try:
        value = json.loads(file.read_text("utf-8"))
    except ValueError as problem:
        raise ConfigError(f"not JSON: {problem}") from problem
    if not isinstance(value, dict) or value.get("schema_version") not in range(1, SCHEMA_VERSION + 1):
        raise ConfigError("unsupported schema_version")
    return value


def save(path: str, value: dict) -> None:
    """Writes beside the target, flushes to disk, restricts access and replaces."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, staged = tempfile.mkstemp(dir=target.parent, prefix=".config-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            json.dump({**value, "schema_version": SCHEMA_VERSION}, out, sort_keys=True, indent=2)
            out.flush()
            os.fsync(out.fileno())
        os.chmod(staged, 0o600)
        os.replace(staged, target)
    except BaseException:
        Path(staged).unlink(missing_ok=True)
        raise


def resolve(overrides: dict, durable: dict, defaults: dict) -> dict:
    """Command line over file over default; identity fields come from one place, complete."""
    for name, level in (("overrides", overrides), ("file", durable)):
        given = [k for k in IDENTITY if level.get(k) is not None]
        if given and len(given) < len(IDENTITY):
            raise ConfigError(f"{name}: {', '.join(IDENTITY)} go together")
    source = next((level for level in (overrides, durable, defaults) if level.get(IDENTITY[0]) is not None), {})
    out = {}
    for key in {*overrides, *durable, *defaults} - {*IDENTITY, "schema_version"}:
        out[key] = next((level[key] for level in (overrides, durable, defaults) if level.get(key) is not None), None)
    return out | {k: source.get(k) for k in IDENTITY}
