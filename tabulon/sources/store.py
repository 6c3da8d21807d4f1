"""Small files of the driver: mapping overrides and analysis snapshots, written whole or not at all."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame


def load(path: str | Path) -> dict:
    """The JSON object in path, {} without a file; ValueError names the line of a syntax error."""
    try:
        return json.loads(Path(path).read_text())
    except FileNotFoundError:
        return {}
    except json.JSONDecodeError as e:
        raise ValueError(f"{path}, line {e.lineno}: {e.msg}") from e


def save(path: str | Path, value: dict) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}")
    with os.fdopen(handle, "w") as f:
        json.dump(value, f, indent=2, sort_keys=True)
    os.replace(name, path)


@contextlib.contextmanager
def changing(path: str | Path) -> Iterator[dict]:
    """The object to change; other processes wait."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(f"{path}.lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        value = load(path)
        yield value
        save(path, value)


def set_mapping(path: str | Path, doctype: str, column: str, target: str | None) -> str | None:
    """Forces a column's target (None: leaves it out); gives the previous one."""
    with changing(path) as value:
        own = value.setdefault(doctype, {}).setdefault("mappings", {})
        previous, own[column] = own.get(column), target
    return previous


def unset_mapping(path: str | Path, doctype: str, column: str) -> bool:
    with changing(path) as value:
        return value.get(doctype, {}).get("mappings", {}).pop(column, KeyError) is not KeyError


def save_analysis(folder: str | Path, slug: str, stamp: str, analysis: dict, keep: int = 10) -> Path:
    """A snapshot and the stable worksheet; only the newest `keep` snapshots of a slug stay."""
    folder = Path(folder)
    path = folder / f"{slug}-{stamp}.json"
    save(path, analysis)
    save(folder / f"{slug}.json", analysis)
    for old in sorted(folder.glob(f"{slug}-*.json"))[:-keep]:
        old.unlink()
    return path


def write_template(template: DataFrame, path: str) -> None:
    """The bulk-import CSV, every cell quoted."""
    template.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
