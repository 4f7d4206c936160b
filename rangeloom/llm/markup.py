"""Tags and character references of HTML, read in time linear in the source whatever is broken in it."""

from __future__ import annotations

import html
import re

# The usual tag: no "<" inside, so that a failed try reads no further than the next tag.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>\"'<]*)([^>\"'<]*(?:\"[^\"<>]*\"[^>\"'<]*)*)>")
_STOPS = {"end": re.compile(r"[>\"']"), "name": re.compile(r"[\s/>]"), '"': re.compile('"'), "'": re.compile("'")}
_NUMBER = re.compile(r"&#(?:([0-9]{8,})|[xX]([0-9a-fA-F]{7,}));?")


def unescape(text: str) -> str:
    """Character references decoded; numbers of any length, those beyond Unicode as U+FFFD."""
    if "&" not in text:
        return text

    def number(m: re.Match) -> str:
        digits = (m[1] or m[2]).lstrip("0")
        return "�" if len(digits) > 7 else html.unescape(f"&#{'' if m[1] else 'x'}{digits or '0'};")

    # A decoded "&" must not start another reference.
    out, at = [], 0
    for m in _NUMBER.finditer(text):
        out += [html.unescape(text[at : m.start()]), number(m)]
        at = m.end()
    return "".join([*out, html.unescape(text[at:])])


class Tags:
    """The tags, comments and declarations of ``source`` in order. ``at`` is where reading goes on and may be moved ahead."""

    def __init__(self, source: str):
        self.source, self.at = source, 0
        self.last = source.rfind(">")
        self.near: dict[str, tuple[int, int]] = {}  # the last search for a stop: from where, found where
        self.failed: set[int] = set()  # places outside quotes from which no end follows

    def _stop(self, kind: str, at: int) -> int:
        low, found = self.near.get(kind, (0, -1))
        if not low <= at <= found:
            m = _STOPS[kind].search(self.source, at)
            found = m.start() if m else len(self.source)
            self.near[kind] = (at, found)
        return found

    def _end(self, at: int) -> int:
        """Where the tag ends whose attributes begin at ``at``, outside quotes; -1 if it doesn't."""
        seen, size = [], len(self.source)
        while at not in self.failed:
            seen.append(at)
            at = self._stop("end", at)
            if at >= size:
                break
            if self.source[at] == ">":
                return at
            at = self._stop(self.source[at], at + 1) + 1
            if at > size:
                break
        self.failed.update(seen)
        return -1

    def next(self) -> tuple[int, bool, str | None, str] | None:
        """(start, closes, name or None for comments and declarations, attributes); a "<" that starts none of these is text."""
        source, at = self.source, self.at
        while (at := source.find("<", at)) >= 0:
            if at > self.last:  # only a comment needs no end
                at = source.find("<!--", at)
                if at < 0:
                    return None
            m = _PLAIN.match(source, at)
            if m:
                self.at = m.end()
                return at, bool(m[1]), m[2].lower(), m[3]
            after = source[at + 1 : at + 2]
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                self.at = len(source) if end < 0 else end + 3
                return at, False, None, ""
            if after in ("!", "?"):
                self.at = source.find(">", at) + 1
                return at, False, None, ""
            name = at + 1 + (after == "/")
            if source[name : name + 1].isalpha() and source[name].isascii():
                stop = self._stop("name", name)
                end = self._end(stop) if stop < len(source) else -1
                if end >= 0:
                    self.at = end + 1
                    return at, after == "/", source[name:stop].lower(), source[stop:end]
            at += 1
        return None

    def skip(self, name: str) -> None:
        """Reading goes on behind the end tag of ``name``, or at the end of the source."""
        m = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(self.source, self.at)
        self.at = m.end() if m else len(self.source)
