"""A reviewed migration as a folder: text both ways, the schema it leads to, and their digests."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import re
import shutil
import tempfile
from dataclasses import dataclass
from pathlib import Path

from .model import SchemaError
from .snapshot import Snapshot

FORMAT = 1
ID_BYTES = 128
#: Files of an artifact and the most bytes of each. Fixed values.
FILES = {"up.sql": 16 << 20, "down.sql": 16 << 20, "snapshot.json": 8 << 20}
MANIFEST_BYTES = 1 << 20


def checked_id(id_: str) -> str:
    """YYYYMMDDHHMMSS_lower_snake, with a time that exists."""
    if len(id_.encode()) > ID_BYTES or not re.fullmatch(r"\d{14}_[a-z0-9]+(?:_[a-z0-9]+)*", id_):
        raise SchemaError("a migration's id is a time and a name in snake case")
    try:
        dt.datetime.strptime(id_[:14], "%Y%m%d%H%M%S")
    except ValueError:
        raise SchemaError("a migration's id has a time that doesn't exist") from None
    return id_


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass(frozen=True)
class Artifact:
    id: str
    up: str
    down: str
    snapshot: Snapshot
    risk: str

    @property
    def files(self) -> dict[str, str]:
        line = lambda s: s.replace("\r\n", "\n").replace("\r", "\n").rstrip("\n") + "\n"
        return {"up.sql": line(self.up), "down.sql": line(self.down), "snapshot.json": self.snapshot.marshal()}

    @property
    def manifest(self) -> str:
        return json.dumps({"format": FORMAT, "id": self.id, "risk": self.risk, "sha256": {n: _digest(t) for n, t in self.files.items()}}, indent=2) + "\n"

    @property
    def checksum(self) -> str:
        return _digest(self.manifest)

    def validate(self) -> Artifact:
        checked_id(self.id)
        for name, text in self.files.items():
            if len(text.encode()) > FILES[name] or "\0" in text:
                raise SchemaError(f"{name} is too large or holds a NUL")
        return self


def write(root: str, artifact: Artifact) -> Path:
    """Write the folder in one move; an id that is there is an error."""
    artifact.validate()
    base = Path(root)
    base.mkdir(parents=True, exist_ok=True)
    target = base / artifact.id
    if target.exists():
        raise SchemaError("the migration is there already")
    part = Path(tempfile.mkdtemp(prefix=".", dir=base))
    try:
        for name, text in {**artifact.files, "manifest.json": artifact.manifest}.items():
            with open(part / name, "w", encoding="utf-8", newline="\n") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
        os.rename(part, target)
    except BaseException:
        shutil.rmtree(part, ignore_errors=True)
        raise
    held = os.open(base, os.O_RDONLY)
    try:
        os.fsync(held)
    finally:
        os.close(held)
    return target


def _read(path: Path, most: int) -> str:
    if path.is_symlink() or not path.is_file() or path.stat().st_size > most:
        raise SchemaError(f"{path.name} is missing, no plain file or too large")
    return path.read_bytes().decode()


def load(root: str, id_: str) -> Artifact:
    """Read a folder back; a changed file is an error."""
    folder = Path(root) / checked_id(id_)
    try:
        manifest = json.loads(_read(folder / "manifest.json", MANIFEST_BYTES))
    except ValueError as e:
        raise SchemaError("the manifest can't be read") from e
    if not isinstance(manifest, dict) or set(manifest) != {"format", "id", "risk", "sha256"} or manifest["format"] != FORMAT or manifest["id"] != id_:
        raise SchemaError("the manifest is of another format or migration")
    texts = {name: _read(folder / name, most) for name, most in FILES.items()}
    if {n: _digest(t) for n, t in texts.items()} != manifest["sha256"]:
        raise SchemaError("a file of the migration has changed")
    return Artifact(id_, texts["up.sql"], texts["down.sql"], Snapshot.parse(texts["snapshot.json"]), manifest["risk"])


def ids(root: str) -> list[str]:
    """The migrations of a folder in order; hidden entries are passed over."""
    base = Path(root)
    if not base.exists():
        return []
    found = sorted(p for p in base.iterdir() if not p.name.startswith("."))
    if any(not p.is_dir() for p in found):
        raise SchemaError("the migrations' folder holds another file")
    return [checked_id(p.name) for p in found]
