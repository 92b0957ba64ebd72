"""Plain versions of the jobs over notes, for small inputs."""

from __future__ import annotations

import re


def blocks(body):
    """(index, type, title, level, start, end, content) line by line."""
    lines, out, i, title = (body or "").split("\n"), [], 0, None
    at = [0]
    for x in lines:
        at.append(at[-1] + len(x) + 1)
    hashes, number, item = (lambda x, p=p: re.match(p, x) for p in (r"^(#{1,6})\s+(.+)$", r"^(\d+)\.\s+(.+)$", r"^(\s*)([-*+]|\d+\.)\s+(.+)$"))
    fence = lambda x: x.strip().startswith("```")
    stops = lambda x: not x.strip() or re.match(r"^#{1,6}\s+", x) or re.match(r"^(\s*)([-*+]|\d+\.)\s+", x) or fence(x)
    while i < len(lines):
        first, x = i, lines[i]
        i += 1
        level = None
        if m := hashes(x) or number(x):
            kind, title, level = "heading", m[2].strip() or None, len(m[1]) if hashes(x) else 2
        elif fence(x):
            kind = "code"
            while i < len(lines):
                i += 1
                if fence(lines[i - 1]):
                    break
        elif item(x):
            kind = "list"
            while i < len(lines) and (item(lines[i]) or (not lines[i].strip() and i + 1 < len(lines))):
                i += 1
        elif not x.strip():
            continue
        else:
            kind = "body"
            while i < len(lines) and not stops(lines[i]):
                i += 1
        out.append((len(out), kind, title, level, at[first], at[i], "\n".join(lines[first:i])))
    return out


def title_match(text, title):
    text, title = text.lower().strip(), title.lower().strip()
    own = {w for w in text.split() if len(w) >= 3}
    words = [w for w in title.split() if len(w) >= 3]
    k = sum(w in own for w in words)
    return bool(title) and title in text or k >= 2 or (bool(words) and k / len(words) >= 0.6)


def similar(a, b):
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y) if x | y else 0.0


# Pseudo-headings of notes without headings.
PSEUDO = re.compile(r"(?:Plan|Roadmap|Execution|Next Steps|Decisions|Goals|Scope|Timeline|Strategy):|Q[1-4]\s+\d{4}|H[12]\s+\d{4}|Phase\s+\d+|Sprint\s+\d+", re.I)
_ITEM = re.compile(r"[-*+•]\s|\d+[.)]\s")


def line_kinds(lines: list[str]) -> list[str]:
    """The type of each line; code fences need the lines before."""
    out, fence = [], ""
    for line in lines:
        t = line.strip()
        mark = t[:3] if t[:3] in ("```", "~~~") else ""
        if mark and (not fence or mark[0] == fence[0]):
            fence = "" if fence else mark
            out.append("code")
        elif fence:
            out.append("code")
        elif not t:
            out.append("blank")
        elif re.match(r"#{1,6}\s", t):
            out.append("heading")
        elif re.match(r">\s", t):
            out.append("quote")
        else:
            out.append("list_item" if _ITEM.match(t) else "paragraph")
    return out


def sections_of(body: str) -> list[tuple]:
    """(heading, level, start line, end line, text, lines, list items) of a note.

    Markdown headings; before the first of them also short plain lines without a closing stop, and while there is no heading at all
    the pseudo-headings. A heading without body passes its name on to the next section.
    """
    lines = body.split("\n")
    kinds = line_kinds(lines)
    found: list[tuple[str, int, int, list[int]]] = []
    open_: tuple[str, int, int, list[int]] | None = None
    markdown = headed = False
    for i, (line, kind) in enumerate(zip(lines, kinds, strict=True)):
        t, head = line.strip(), None
        if kind == "heading":
            marks = len(t) - len(t.lstrip("#"))
            head, markdown = (t[marks:].strip(), marks), True
        elif kind == "paragraph" and (not markdown or (open_ and open_[0] == "General")) and len(t) <= 40 and t[-1] not in ".?!" and (i + 1 == len(lines) or kinds[i + 1] in ("blank", "paragraph", "list_item")):
            head = (t.removesuffix(":"), 2)
        elif not headed and PSEUDO.match(t):
            head = (line.removesuffix(":").strip(), 2)
        if head:
            headed = True
            if open_ and open_[3]:
                found.append(open_)
            open_ = (*head, i, [])
        elif open_:
            open_[3].append(i)
        elif not headed:
            open_ = ("General", 1, i, [i])
    if open_ and open_[3]:
        found.append(open_)
    out, waiting = [], []
    for head, level, start, own in found:
        text = "\n".join(lines[i] for i in own)
        if not text.strip():
            if head and head != "General":
                waiting.append(head)
            continue
        name = " > ".join([*waiting, *([head] if head else [])])
        out.append((name, level, start, own[-1], text, len(own), sum(kinds[i] == "list_item" for i in own)))
        waiting = []
    return out
