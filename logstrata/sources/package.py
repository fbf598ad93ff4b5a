"""A case package: an uncompressed zip of an archive with a manifest, and the Info.plist of an archive."""

from __future__ import annotations

import hashlib
import json
import plistlib
import zipfile
from pathlib import Path, PurePosixPath

from .binary import Cursor, Truncated, uuid
from .containers import SourceError, _copy, _target
from .tracev3 import HEADER, chunks

MANIFEST, SIDECAR, VERSION = "package/manifest.json", "package/acquisition.json", 1


def pack(archive: str, out: str, sidecar: dict | None = None) -> dict:
    """Writes the package; returns its manifest, with size and digest of each file."""
    root = Path(archive)
    files = [p for p in sorted(root.rglob("*")) if p.is_file() and not p.is_symlink()]
    manifest = {"version": VERSION, "root": "archive", "files": {str(p.relative_to(root)): {"size": p.stat().st_size, "sha256": hashlib.sha256(p.read_bytes()).hexdigest()} for p in files}}
    partial = Path(f"{out}.partial")
    with zipfile.ZipFile(partial, "w", zipfile.ZIP_STORED) as z:
        z.writestr(MANIFEST, json.dumps(manifest, indent=1))
        if sidecar is not None:
            z.writestr(SIDECAR, json.dumps(sidecar))
        for p in files:
            z.write(p, f"archive/{p.relative_to(root)}")
    partial.replace(out)
    return manifest


def is_package(path: str) -> bool:
    try:
        with zipfile.ZipFile(path) as z:
            return MANIFEST in z.namelist()
    except (OSError, zipfile.BadZipFile):
        return False


def manifest(path: str) -> dict:
    with zipfile.ZipFile(path) as z:
        found = json.loads(z.read(MANIFEST))
    if not 1 <= found.get("version", 0) <= VERSION:
        raise SourceError(f"{path}: version {found.get('version')}")
    return found


def sidecar(path: str) -> dict | None:
    """The acquisition report inside a package, or beside an archive as <name>.acquisition.json."""
    if is_package(path):
        with zipfile.ZipFile(path) as z:
            return json.loads(z.read(SIDECAR)) if SIDECAR in z.namelist() else None
    beside = Path(f"{path}.acquisition.json")
    return json.loads(beside.read_text()) if beside.is_file() else None


def unpack(path: str, work: str) -> str:
    """The archive's folder, every file held against the manifest."""
    known, w = manifest(path), Path(work)
    with zipfile.ZipFile(path) as z:
        for name, facts in known["files"].items():
            target = _target(w, PurePosixPath(name))
            with z.open(f"archive/{name}") as f:
                _copy(f, target)
            if hashlib.sha256(target.read_bytes()).hexdigest() != facts["sha256"]:
                raise SourceError(f"{path}: {name} is not what the manifest says")
    return str(w)


def header_facts(data: bytes) -> tuple[str, int] | None:
    """(boot uuid, continuous time) of a log file's header."""
    for tag, _, body in chunks(data):
        if tag == HEADER:
            try:
                c, found = Cursor(body, 8), {"boot": "", "time": 0}
                found["time"] = c.take("Q")
                c.at = 40
                while len(c) >= 8:
                    part, size = c.take("II")
                    inner = c.raw(size)
                    if part == 0x6100:
                        found["time"] = Cursor(inner).take("Q")
                    elif part == 0x6102:
                        found["boot"] = uuid(inner[:16])
            except Truncated:
                return None
            return found["boot"], found["time"]
    return None


def info_plist(archive: str) -> bytes:
    """An Info.plist: the archive ends where the newest file of any stream does."""
    ends = {}
    for stream in ("Persist", "Special", "Signpost", "HighVolume"):
        files = sorted(p for p in (Path(archive) / stream).glob("*.tracev3") if not p.name.startswith("._"))
        if files and (facts := header_facts(files[-1].read_bytes())):
            ends[stream] = facts
    if not ends:
        raise SourceError(f"{archive}: no readable log")
    boot, time = max(ends.values(), key=lambda f: f[1])
    streams = {f"{k}Metadata": {"OldestTimeRef": {"UUID": f[0], "ContinuousTime": f[1]}} for k, f in ends.items()}
    return plistlib.dumps({"OSArchiveVersion": 4, "EndTimeRef": {"UUID": boot, "ContinuousTime": time, "WallTime": 0}, **streams})
