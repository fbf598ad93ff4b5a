"""Knowledge base: signatures and labels, read from YAML, checked, written."""

from __future__ import annotations

import difflib
import hashlib
import re
from dataclasses import dataclass, field
from pathlib import Path

from .schemas import EVENT_TYPES, LOG_LEVELS


class KnowledgeBaseError(ValueError):
    """A signature or label file that breaks the rules, with its place."""


@dataclass(frozen=True)
class Match:
    format_str: str | None = None
    format_str_any: tuple[str, ...] = ()
    dynamic: bool = False
    process: str | None = None
    subsystem: str | None = None
    category: str | None = None
    log_level: str | None = None
    event_type: str | None = None
    library: str | None = None
    message_regex: str | None = None


@dataclass(frozen=True)
class Signature:
    id: str
    action: str
    description: str
    match: Match
    interpretation: str = ""
    caveats: str = ""
    extract_regex: str | None = None
    extract_fields: tuple[tuple[str, str], ...] = ()
    confidence: str = "medium"
    platform: str = "ios"
    ios_min: str | None = None
    ios_max: str | None = None
    references: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    author: str = ""
    created: str = ""
    version: str = ""
    status: str = "validated"
    source_file: str = ""

    @property
    def labels(self) -> list[str]:
        named = list(re.compile(self.extract_regex).groupindex) if self.extract_regex else []
        return [*named, *[k for k, _ in self.extract_fields]]


@dataclass(frozen=True)
class KnowledgeBase:
    version: str
    signatures: tuple[Signature, ...] = ()
    labels: dict[str, str] = field(default_factory=dict)
    digest: str = ""


def in_version_range(version: str | None, least: str | None, most: str | None) -> bool:
    """A version that isn't known, or a bound that is no dotted number, constrains nothing."""

    def numbers(v: str | None) -> tuple[int, ...] | None:
        return tuple(map(int, v.split("."))) if v and re.fullmatch(r"\d+(\.\d+)*", v) else None

    v, a, b = numbers(version), numbers(least), numbers(most)
    return v is None or (a is None or v >= a) and (b is None or v <= b)


#: Keys of a signature in a file; those that have two spellings read the same.
_KEYS = {"id", "action", "description", "match", "interpretation", "caveats", "confidence", "platform", "ios_min", "ios_max", "references", "tags", "author", "created", "version", "status"}
_SPELLINGS = {"extract_regex": "extract-regex", "extract_fields": "extract-fields"}
STATUSES = ("draft", "validated", "deprecated")
_MATCH_KEYS = set(Match.__dataclass_fields__)


def _text(raw: dict, key: str, where: str, needed: bool = False) -> str | None:
    v = raw.get(key)
    if v is None and not needed:
        return None
    if not isinstance(v, str) or needed and not v.strip():
        raise KnowledgeBaseError(f"{where}: {key} must be a text")
    return v


def _texts(raw: dict, key: str, where: str) -> tuple[str, ...]:
    v = raw.get(key) or []
    if not isinstance(v, list) or not all(isinstance(x, str) for x in v):
        raise KnowledgeBaseError(f"{where}: {key} must be a list of texts")
    return tuple(v)


def build_signature(raw: object, where: str) -> Signature:
    """A checked signature from what a file says."""
    if not isinstance(raw, dict):
        raise KnowledgeBaseError(f"{where}: a signature must be a mapping")
    where = f"{where}: {raw.get('id', '?')}"
    raw = dict(raw)
    for other, key in _SPELLINGS.items():
        if (value := raw.pop(other, None)) and not raw.get(key):
            raw[key] = value
    if odd := sorted(set(raw) - _KEYS - set(_SPELLINGS.values())):
        raise KnowledgeBaseError(f"{where}: unknown keys {odd}")
    m = raw.get("match")
    if not isinstance(m, dict) or set(m) - _MATCH_KEYS:
        raise KnowledgeBaseError(f"{where}: match must be a mapping of {sorted(_MATCH_KEYS)}")
    if (m.get("format_str") is not None) + bool(m.get("format_str_any")) + bool(m.get("dynamic")) != 1:
        raise KnowledgeBaseError(f"{where}: exactly one of format_str, format_str_any and dynamic")
    for key, known in (("log_level", LOG_LEVELS), ("event_type", EVENT_TYPES)):
        if m.get(key) is not None and m[key] not in known:
            raise KnowledgeBaseError(f"{where}: {key} must be one of {known}")
    fields = raw.get("extract-fields") or {}
    if not isinstance(fields, dict):
        raise KnowledgeBaseError(f"{where}: extract-fields must be a mapping")
    for pattern in (m.get("message_regex"), raw.get("extract-regex"), *fields.values()):
        try:
            re.compile(pattern or "")
        except (re.error, TypeError) as e:
            raise KnowledgeBaseError(f"{where}: {pattern!r}: {e}") from e
    confidence = raw.get("confidence", "medium")
    if confidence not in ("low", "medium", "high"):
        raise KnowledgeBaseError(f"{where}: confidence must be low, medium or high")
    status = _text(raw, "status", where) or "validated"
    if status not in STATUSES:
        raise KnowledgeBaseError(f"{where}: status must be one of {STATUSES}")
    plain = {k: _text(m, k, where) for k in _MATCH_KEYS - {"format_str_any", "dynamic"}}
    return Signature(
        id=_text(raw, "id", where, True), action=_text(raw, "action", where, True), description=_text(raw, "description", where, True),
        match=Match(format_str_any=_texts(m, "format_str_any", where), dynamic=bool(m.get("dynamic")), **plain),
        interpretation=_text(raw, "interpretation", where) or "", caveats=_text(raw, "caveats", where) or "", extract_regex=_text(raw, "extract-regex", where), extract_fields=tuple(fields.items()),
        confidence=confidence, platform=_text(raw, "platform", where) or "ios", ios_min=_text(raw, "ios_min", where), ios_max=_text(raw, "ios_max", where), references=_texts(raw, "references", where), tags=_texts(raw, "tags", where),
        author=str(raw.get("author") or ""), created=str(raw.get("created") or ""), version=str(raw.get("version") or ""), status=status, source_file=where.split(":")[0],
    )


def load_kb(root: str) -> KnowledgeBase:
    """VERSION, labels.yaml (may be absent) and signatures/*.yaml of a folder. Needs the yaml library."""
    import yaml

    folder = Path(root)
    if not (folder / "VERSION").is_file():
        raise KnowledgeBaseError(f"{folder}: no VERSION")
    version = (folder / "VERSION").read_text().strip()
    digest, labels, found = hashlib.sha256(version.encode()), {}, []
    if (folder / "labels.yaml").is_file():
        raw = (folder / "labels.yaml").read_bytes()
        digest.update(raw)
        labels = (yaml.safe_load(raw) or {}).get("labels") or {}
    for path in sorted((folder / "signatures").glob("*.yaml")):
        raw = path.read_bytes()
        digest.update(path.name.encode() + b"\0" + raw)
        found += [build_signature(s, path.name) for s in (yaml.safe_load(raw) or {}).get("signatures") or []]
    ids = [s.id for s in found]
    if double := sorted({i for i in ids if ids.count(i) > 1}):
        raise KnowledgeBaseError(f"ids that occur twice: {double}")
    return KnowledgeBase(version, tuple(found), labels, digest.hexdigest())


def lint_labels(kb: KnowledgeBase) -> list[tuple[str, str, str | None]]:
    """(signature, label, suggestion) for labels that the vocabulary does not have; none without a vocabulary."""
    if not kb.labels:
        return []
    lower = {k.lower(): k for k in kb.labels}
    out = []
    for s in kb.signatures:
        for label in s.labels:
            if label not in kb.labels:
                near = lower.get(label.lower()) or next(iter(difflib.get_close_matches(label, kb.labels, 1, 0.6)), None)
                out.append((s.id, label, near))
    return out


def render_signature(s: Signature) -> str:
    """YAML that reads back as the same signature: all texts double-quoted."""
    import json

    q = lambda v: json.dumps(v, ensure_ascii=False)  # noqa: E731  (a JSON text is a YAML text)
    lines = [f"- id: {q(s.id)}", f"  action: {q(s.action)}", f"  description: {q(s.description)}"]
    for key in ("interpretation", "caveats", "confidence", "platform", "ios_min", "ios_max", "author", "created", "version", "status"):
        if v := getattr(s, key):
            lines.append(f"  {key}: {q(v)}")
    lines.append("  match:")
    for key in Match.__dataclass_fields__:
        if v := getattr(s.match, key):
            lines.append(f"    {key}: {q(list(v)) if isinstance(v, tuple) else 'true' if v is True else q(v)}")
    if s.extract_regex:
        lines.append(f"  extract-regex: {q(s.extract_regex)}")
    if s.extract_fields:
        lines += ["  extract-fields:"] + [f"    {q(k)}: {q(v)}" for k, v in s.extract_fields]
    for key in ("references", "tags"):
        if v := getattr(s, key):
            lines.append(f"  {key}: {q(list(v))}")
    return "\n".join(lines) + "\n"
