"""A scanner of HTML markup whose time is linear in the page, whatever is broken in it."""

from __future__ import annotations

import re
from collections.abc import Iterator

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]+|=)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")


class Scanner:
    """Tags and texts of a page in one pass: every step moves on, so time is linear whatever the markup.

    The ends of tags and quotes are asked for only before the last one of the page. A tag that never ends is text.
    """

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in ">\"'"}

    def _end(self, char: str, at: int) -> int:
        """The place after the next char, -1 if there is none."""
        return self.page.find(char, at) + 1 if at <= self.last[char] else -1

    def tag(self, at: int) -> tuple[str, dict[str, str], bool, int] | None:
        """Name (with its slash if it closes), attributes, whether a slash ends it, and where what follows begins. None: text."""
        if at > self.last[">"] or (name := _NAME.match(self.page, at + 1)) is None:
            return None
        found: dict[str, str] = {}
        page, i = self.page, name.end()
        while m := _ATTRIBUTE.match(page, i):
            i, value = m.end(), ""
            if m[2]:
                quote = page[i : i + 1]
                if quote in ('"', "'") and (end := self._end(quote, i + 1)) > 0:
                    value, i = page[i + 1 : end - 1], end
                else:
                    bare = _BARE.match(page, i)
                    value, i = bare[0], bare.end()
            found.setdefault(m[1].lower(), value)
        end = self._end(">", i)
        return (name[0].lower(), found, page[end - 2] == "/", end) if end > 0 else None

    def skip_raw(self, tag: str, at: int) -> int:
        """The place after the element's closing tag, or the page's end."""
        close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(self.page, at)
        end = self._end(">", close.end()) if close else -1
        return end if end > 0 else len(self.page)

    def declaration(self, at: int) -> int:
        """The place after a comment or declaration."""
        if self.page.startswith("<!--", at):
            end = self.page.find("-->", at + 4) + 3
            return end if end > 2 else len(self.page)
        end = self._end(">", at)
        return end if end > 0 else len(self.page)


TEXT, OPEN, CLOSE = "text", "open", "close"
#: Elements whose content is no markup.
RAW_TEXT = frozenset({"script", "style"})


def events(page: str) -> Iterator[tuple[str, str]]:
    """(TEXT, run), (OPEN, name) and (CLOSE, name) in page order; an element that a slash ends opens and closes.

    A less-than sign that begins no tag is a run of its own; comments, declarations and raw content are left out.
    """
    scan, at = Scanner(page), 0
    while at < len(page):
        if page[at] != "<":
            end = page.find("<", at)
            end = end if end >= 0 else len(page)
            yield TEXT, page[at:end]
            at = end
        elif page[at + 1 : at + 2] in ("!", "?"):
            at = scan.declaration(at)
        elif (found := scan.tag(at)) is None:
            yield TEXT, "<"
            at += 1
        else:
            name, _, slash, at = found
            yield (CLOSE, name[1:]) if name[0] == "/" else (OPEN, name)
            if name in RAW_TEXT:
                at = scan.skip_raw(name, at)
            if name in RAW_TEXT or slash and name[0] != "/":
                yield CLOSE, name
