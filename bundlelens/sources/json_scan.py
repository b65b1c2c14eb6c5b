"""Entries of JSON documents written back to back, cut out of a stream.

A file is read piece by piece. Where strings, escapes and brackets begin and end is carried from piece to piece, so what is held is one piece,
the entry being cut and a document without its entries, whatever the size of the file. An entry is parsed once.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

OUTSIDE = re.compile(r'["{}\[\],]')
INSIDE = re.compile(r'["\\]')
NOT_BLANK = re.compile(r"[^ \t\n\r]")
BLANK = " \t\n\r"
SCAN = json.JSONDecoder().scan_once
FIELD = "content"


class BadDocument(ValueError):
    """Why a document can't be read."""


def _parsed(text: str):
    try:
        return json.loads(text)
    except (ValueError, RecursionError) as trouble:
        raise BadDocument(str(trouble) or "nested too deeply") from None


def _quick(text: str, at: int):
    """(entry, place of the comma or bracket behind it) where a whole entry lies in the piece, else None."""
    if text[at:at + 1] in BLANK:  # or at the end
        begin = NOT_BLANK.search(text, at)
        if not begin:
            return None
        at = begin.start()
    if text[at] in ",]":
        return None
    try:
        value, end = SCAN(text, at)
    except (ValueError, RecursionError, StopIteration):
        return None
    if text[end:end + 1] in BLANK:
        behind = NOT_BLANK.search(text, end)
        if not behind:
            return None
        end = behind.start()
    return (value, end) if text[end] in ",]" else None


class _Scanner:
    """Cuts documents and the entries of their content list out of pieces of text."""

    def __init__(self):
        self.depth = self.number = self.count = 0
        self.string = self.escape = False
        self.inside = self.seen = self.slow = False  # in the list; a list was seen; its current entry is cut by hand
        self.rest: list[str] = []  # the document without its entries
        self.element: list[str] = []
        self.key, self.begun = None, []  # the last string on the top level, and the one being read

    def _entry(self, value):
        self.count, self.element, self.slow = self.count + 1, [], False
        return self.number, self.count - 1, value

    def _document(self):
        """Entries that the document's end brings to light; checks what is left of it."""
        document = _parsed("".join(self.rest))
        content = document.get(FIELD, [])
        if not isinstance(content, list):
            raise BadDocument("content is no list")
        late = [] if self.seen else [(self.number, i, value) for i, value in enumerate(content)]
        self.number, self.rest, self.seen, self.key = self.number + 1, [], False, None
        return late

    def feed(self, text: str) -> Iterator[tuple]:
        """(document, entry number, entry) of what ends in this piece."""
        at = i = 0  # what is kept up to, what is looked at up to
        begin = 0
        while True:
            if self.escape:
                if i >= len(text):
                    break
                i, self.escape = i + 1, False
            if self.string:
                m = INSIDE.search(text, i)
                if not m:
                    break
                i = m.end()
                if m[0] == "\\":
                    self.escape = True
                    continue
                self.string = False
                if self.depth == 1:
                    self.key, self.begun = "".join(self.begun) + text[begin:i], []
                continue
            if self.inside and self.depth == 2 and not self.slow:
                quick = _quick(text, at) if not self.element or not any(map(str.strip, self.element)) else None
                if quick:
                    value, end = quick
                    yield self._entry(value)
                    at = i = end + 1
                    if text[end] == "]":
                        at, self.inside, self.depth = end, False, 1
                    continue
                self.slow = True
            m = OUTSIDE.search(text, i)
            if not m:
                break
            c, place, i = m[0], m.start(), m.end()
            if self.depth == 0:
                if c != "{" or "".join(self.rest).strip() or text[at:place].strip():
                    raise BadDocument("not an object")
                at, self.rest, self.depth = place, [], 1
            elif c == '"':
                self.string, begin = True, place
            elif c in "{[":
                self.depth += 1
                if c == "[" and self.depth == 2 and self.key == f'"{FIELD}"':
                    if self.seen:
                        raise BadDocument("content is given twice")
                    self.rest.append(text[at:i])
                    at, self.inside, self.seen, self.count, self.element, self.slow = i, True, True, 0, [], False
            elif c == ",":
                if self.inside and self.depth == 2:
                    yield self._entry(_parsed("".join(self.element) + text[at:place]))
                    at = i
                elif self.depth == 1:
                    self.key = None
            elif self.inside and self.depth == 2:
                last = "".join(self.element) + text[at:place]
                if c != "]":
                    raise BadDocument("brackets do not match")
                if last.strip() or self.count:
                    yield self._entry(_parsed(last))
                at, self.inside, self.depth, self.element = place, False, 1, []
            else:
                self.depth -= 1
                if self.depth == 0:
                    self.rest.append(text[at:i])
                    at = i
                    yield from self._document()
        (self.element if self.inside else self.rest).append(text[at:])
        if self.string and self.depth == 1:
            self.begun.append(text[begin:])
        if self.depth == 0 and text[at:].strip():
            raise BadDocument("not an object")

    def end(self) -> None:
        if self.depth or self.string:
            raise BadDocument("it ends early")


def entries_of(pieces: Iterable[bytes]) -> Iterator[tuple]:
    """(document number, entry number, entry, error) of documents back to back in a stream of bytes.

    Reading ends at the first bad document with a row that holds the error; entries of that document may have come before.
    """
    decoder, scanner = codecs.getincrementaldecoder("utf-8-sig")("replace"), _Scanner()
    try:
        for text in chain((decoder.decode(piece) for piece in pieces), [decoder.decode(b"", True)]):
            for found in scanner.feed(text):
                yield *found, None
        scanner.end()
    except BadDocument as trouble:
        yield scanner.number, None, None, f"bad document: {trouble}"
