"""Results as text. Every function takes small results that are already on the driver."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence

from ..kb import KnowledgeBase, Signature, lint_labels


def grid(rows: Iterable[Sequence], head: Sequence[str]) -> str:
    """Columns as wide as their widest cell; numbers to the right."""
    cells = [[("" if v is None else f"{v:,.2f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v)) for v in r] for r in rows]
    widths = [max([len(h), *(len(r[k]) for r in cells)]) for k, h in enumerate(head)]
    right = [bool(cells) and all(c[k].replace(",", "").replace(".", "", 1).lstrip("-").isdigit() for c in cells if c[k]) for k in range(len(head))]
    line = lambda r: "  ".join(v.rjust(w) if a else v.ljust(w) for v, w, a in zip(r, widths, right)).rstrip()
    return "\n".join([line(head), line(["-" * w for w in widths]), *map(line, cells)])


def bar(share: float, width: int = 20) -> str:
    full = round(max(0.0, min(1.0, share)) * width)
    return "█" * full + "░" * (width - full)


def duration(seconds: float) -> str:
    days, rest = divmod(int(seconds), 86_400)
    hours, rest = divmod(rest, 3_600)
    minutes, secs = divmod(rest, 60)
    found = [f"{n} {u}" for n, u in ((days, "d"), (hours, "h"), (minutes, "min"), (secs, "s")) if n]
    return " ".join(found[:2]) or "0 s"


def comparison(verdicts: Mapping[str, int], fields: Sequence[tuple[str, int, int, float]], missing: Sequence[tuple[str, int]]) -> str:
    total = verdicts.get("matched", 0) + verdicts.get("missing", 0)
    share = verdicts.get("matched", 0) / total if total else 1.0
    out = [f"Reference logs found: {bar(share)} {100 * share:.2f} %", grid([(k, verdicts.get(k, 0)) for k in ("matched", "missing", "extra")], ("verdict", "logs"))]
    if fields:
        out.append(grid([(f, n, e, float(p)) for f, n, e, p in fields], ("field", "compared", "equal", "percent")))
    if missing:
        out.append(grid(list(missing), ("process", "missing")))
    return "\n\n".join(out)


def files(verdicts: Iterable[tuple[str, str]]) -> tuple[str, bool]:
    """The table of verdicts, and whether nothing but additions separates the two archives."""
    found = list(verdicts)
    counts = Counter(v for _, v in found)
    odd = sorted((p, v) for p, v in found if v not in ("identical", "append"))
    return grid([*sorted(counts.items())], ("verdict", "files")) + ("\n\n" + grid(odd, ("path", "verdict")) if odd else ""), not counts["diverged"] and not counts["only_a"] and not counts["shrunk"]


def checks(found: Iterable) -> str:
    return grid([(c.name, {True: "passed", False: "FAILED", None: "not told"}[c.passed], c.detail) for c in found], ("check", "result", "detail"))


def signatures(kb: KnowledgeBase, tag: str | None = None, process: str | None = None, as_json: bool = False) -> str:
    chosen = [s for s in kb.signatures if (tag is None or tag in s.tags) and (process is None or s.match.process == process)]
    if as_json:
        return json.dumps([{"id": s.id, "action": s.action, "confidence": s.confidence, "tags": list(s.tags)} for s in chosen], ensure_ascii=False)
    return grid([(s.id, s.confidence, s.match.process or "", ", ".join(s.tags), s.action) for s in chosen], ("id", "confidence", "process", "tags", "action"))


def signature(s: Signature) -> str:
    from ..kb import render_signature

    return render_signature(s)


def kb_stats(kb: KnowledgeBase) -> str:
    """Counts by confidence, file and tag; tags by count, then name."""
    tags = sorted(Counter(t for s in kb.signatures for t in s.tags).items(), key=lambda x: (-x[1], x[0]))
    parts = [f"{len(kb.signatures)} signatures, version {kb.version}", grid(sorted(Counter(s.confidence for s in kb.signatures).items()), ("confidence", "signatures")), grid(sorted(Counter(s.source_file for s in kb.signatures).items()), ("file", "signatures")), grid(tags, ("tag", "signatures"))]
    warnings = [f"{i}: label {label!r} is not in the vocabulary" + (f"; did you mean {near!r}?" if near else "") for i, label, near in lint_labels(kb)]
    return "\n\n".join([*parts, *warnings])
