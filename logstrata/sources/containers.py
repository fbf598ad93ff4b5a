"""Archives in other wrappings: unpacked to a folder that the ingest reads."""

from __future__ import annotations

import hashlib
import plistlib
import shutil
import tarfile
import zipfile
from dataclasses import dataclass
from pathlib import Path, PurePosixPath

_MARK = ("diagnostics", "uuidtext")
_ARCHIVE = "system_logs.logarchive"


class SourceError(ValueError):
    pass


@dataclass(frozen=True)
class Prepared:
    kind: str
    root: str
    fingerprint: str | None = None
    product_version: str | None = None


def detect(path: str) -> str:
    """logarchive, loose, sysdiagnose or filesystem, by content first."""
    p = Path(path)
    if p.is_dir():
        if (p / "timesync").is_dir() or any(p.rglob("*.tracev3")) and not loose_dirs(path):
            return "logarchive"
        if loose_dirs(path):
            return "loose"
    elif p.is_file():
        with p.open("rb") as f:
            magic = f.read(4)
        if magic[:2] == b"\x1f\x8b":
            return "sysdiagnose"
        if magic == b"PK\x03\x04":
            return "filesystem"
    raise SourceError(f"{path}: none of logarchive folder, diagnostics and uuidtext folders, sysdiagnose .tar.gz, file system .zip")


def loose_dirs(path: str) -> tuple[str, str] | None:
    """The diagnostics and uuidtext folders at a path or one level below."""
    for base in (Path(path), *[d for d in Path(path).iterdir() if d.is_dir()]):
        if all((base / m).is_dir() for m in _MARK):
            return tuple(str(base / m) for m in _MARK)
    return None


def fingerprint(path: str, part: int = 65_536) -> str:
    """Digest of head, size and tail: enough to notice that a large file changed."""
    p = Path(path)
    size = p.stat().st_size
    with p.open("rb") as f:
        head = f.read(part)
        f.seek(max(0, size - part))
        tail = f.read(part)
    return hashlib.sha256(head + str(size).encode() + tail).hexdigest()


def product_version(data: bytes) -> str | None:
    """The system's version as a SystemVersion.plist states it; None where it can't be read."""
    try:
        found = plistlib.loads(data).get("ProductVersion")
    except Exception:  # a foreign or damaged file says nothing
        return None
    return str(found) if found else None


def archive_facts(archive: str) -> dict:
    """Identifier and version of an archive's Info.plist, as far as it has them."""
    try:
        raw = plistlib.loads((Path(archive) / "Info.plist").read_bytes())
    except Exception:  # none there, or damaged
        return {}
    named = {"identifier": "ArchiveIdentifier", "version": "OSArchiveVersion"}
    return {k: str(raw[v]) for k, v in named.items() if isinstance(raw, dict) and raw.get(v)}


def _says_version(name: str) -> bool:
    return name.replace("\\", "/").lower().rsplit("/", 1)[-1] == "systemversion.plist"


def _target(work: Path, inner: PurePosixPath) -> Path:
    """Where a member goes; never outside the work folder."""
    out = (work / inner).resolve()
    if not out.is_relative_to(work.resolve()):
        raise SourceError(f"member leaves the archive: {inner}")
    return out


def _claim(work: str, reset: bool) -> Path:
    w = Path(work)
    if w.exists() and any(w.iterdir()):
        if not reset:
            raise SourceError(f"{work} is not empty")
        shutil.rmtree(w)
    w.mkdir(parents=True, exist_ok=True)
    return w


def prepare(path: str, work: str, reset: bool = False) -> Prepared:
    """The folder to ingest: the archive itself, or what it unpacks to below ``work``. A failure leaves nothing behind."""
    kind = detect(path)
    if kind == "logarchive":
        return Prepared(kind, path)
    w, version = _claim(work, reset), None
    try:
        if kind == "loose":
            for d in loose_dirs(path):
                shutil.copytree(d, w, dirs_exist_ok=True, copy_function=_link)
        elif kind == "sysdiagnose":
            with tarfile.open(path, "r:gz") as t:
                for m in t:
                    parts = PurePosixPath(m.name).parts
                    if m.isfile() and version is None and _says_version(m.name):
                        version = product_version(t.extractfile(m).read())
                    elif m.isfile() and _ARCHIVE in parts:
                        _copy(t.extractfile(m), _target(w, PurePosixPath(*parts[parts.index(_ARCHIVE) + 1 :])))
        else:
            with zipfile.ZipFile(path) as z:
                root = None
                for name in z.namelist():
                    parts = PurePosixPath(name).parts
                    if version is None and _says_version(name):
                        version = product_version(z.read(name))
                        continue
                    at = next((k for k, x in enumerate(parts) if x in _MARK), None)
                    if at is None or name.endswith("/"):
                        continue
                    root = parts[:at] if root is None else root
                    if parts[:at] == root:
                        with z.open(name) as f:
                            _copy(f, _target(w, PurePosixPath(*parts[at + 1 :])))
        if not any(w.rglob("*.tracev3")):
            raise SourceError(f"{path}: no logs inside")
    except BaseException:
        shutil.rmtree(w, ignore_errors=True)
        raise
    return Prepared(kind, str(w), None if kind == "loose" else fingerprint(path), version)


def _link(src: str, dst: str) -> None:
    import os

    try:
        os.link(src, dst)
    except OSError:
        shutil.copy2(src, dst)


def _copy(src, dst: Path) -> None:
    dst.parent.mkdir(parents=True, exist_ok=True)
    with dst.open("wb") as f:
        shutil.copyfileobj(src, f)
