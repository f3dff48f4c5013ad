"""The bracketed outline of one text in plain Python, for table functions and readers; operators/sections.py has it as columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

from lectern.taxonomy import PLAIN_HEADINGS

_WS = "[\\s　 ]"
_END = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
_NUMBERED = re.compile(rf"^\[([^\]]+)\]{_WS}*(.*)$")
_OUTER = re.compile(rf"^{_WS}+|{_WS}+$")


def _trimmed(text: str) -> str:
    return _OUTER.sub("", text)


def outline(text: str | None) -> Iterator[tuple[int, str | None, str, str]]:
    """ord, section_number, title and content of each section; lines before the first heading fall away."""
    at, number, title, body = -1, None, "", []
    for line in _END.split(text or ""):
        bare = _trimmed(line)
        found = _NUMBERED.match(bare)
        if found or bare in PLAIN_HEADINGS:
            if at >= 0:
                yield at, number, title, _trimmed("\n".join(body))
            number, title = (_trimmed(found[1]), _trimmed(found[2])) if found else (None, bare)
            at, body = at + 1, []
        elif at >= 0:
            body.append(line)
    if at >= 0:
        yield at, number, title, _trimmed("\n".join(body))
