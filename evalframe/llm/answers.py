"""The parts of an answer: explanation, two complexities and a fenced program, in any order and dress."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_LABEL = re.compile(r"^[ \t>#*\-•]*(solution\s+explanation|time\s+complexity|space\s+complexity)\b[ \t*_]*(?:[:：\-–—=][ \t*_]*)?(.*)$", re.I)
_FENCE = re.compile(r"^[ \t>]*(`{3,}|~{3,})[ \t]*([A-Za-z0-9+#_.\-]*)[ \t]*$")
_NON_ALNUM = re.compile(r"[\W_]+")


def letters_digits(text: str) -> str:
    """The letters and digits of a text in order, letter case ignored."""
    return _NON_ALNUM.sub("", text.lower())


@dataclass
class Answer:
    explanation: str | None = None
    time: str | None = None
    space: str | None = None
    code: str | None = None
    closed: bool = False
    loose: str = ""
    #: name of the field in which the text ends
    last: str = ""
    order: list[str] = field(default_factory=list)


def parse_answer(text: str) -> Answer:
    """Split a text into its fields; the first of a repeated field holds, text outside any field is ``loose``."""
    out = Answer()
    parts: dict[str, list[str]] = {}
    loose: list[str] = []
    now, fence = "", ""
    for line in re.split(r"\r\n|\r|\n", text):
        if fence:
            m = _FENCE.match(line) if fence[:3] in line else None
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2]:
                fence, now, out.closed = "", "", True
                out.last = "closed"
            else:
                parts["code"].append(line)
            continue
        m = _FENCE.match(line)
        if m and "code" not in parts:
            fence, now, out.last = m[1], "code", "code"
            parts["code"] = []
            out.order.append("code")
            continue
        m = _LABEL.match(line)
        if m:
            name = {"s": "space", "t": "time"}.get(m[1][0].lower(), "") if "omplexity" in m[1].lower() or "OMPLEXITY" in m[1] else "explanation"
            now = name
            if name in parts:
                now = ""
            else:
                parts[name] = [m[2]]
                out.order.append(name)
            out.last = name
            continue
        if now in ("time", "space") and letters_digits("".join(parts[now])):
            now = ""
        if now:
            parts[now].append(line)
            if line.strip():
                out.last = now
        else:
            loose.append(line)
            if line.strip():
                out.last = "loose"
    for name in ("explanation", "time", "space", "code"):
        if name in parts:
            setattr(out, name, "\n".join(parts[name]).strip())
    out.loose = "\n".join(loose).strip()
    return out
