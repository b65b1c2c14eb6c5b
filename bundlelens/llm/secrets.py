"""Secret scans: nested encodings are unwrapped layer by layer until nothing new appears; every layer is scanned."""

from __future__ import annotations

import base64
import bisect
import codecs
import itertools
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlelens.llm.common import annotate

RESULTS = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "found", "unread")
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("passw", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 6
URL_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE_BEGINS = re.compile(r"[%\\&]")
ESCAPE_ENDS = re.compile(r"%[0-9A-Fa-f]{2}\Z|\\u[0-9A-Fa-f]{4}\Z|\\x[0-9A-Fa-f]{2}\Z|&#x[0-9A-Fa-f]{1,6};\Z|&#[0-9]{1,7};\Z")
ESCAPE_BODY = frozenset("%\\&#xu;0123456789abcdefABCDEF")
HEX_DIGITS = frozenset("0123456789abcdefABCDEF")
LONGEST_ESCAPE = 10
UNICODE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
BASE64_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}(?:(?:\r?\n|\\r\\n|\\n)[\x20\t]*[A-Za-z0-9+/_-]++={0,2})+")
BASE64_LINE = re.compile(r"(?:\A|\r?\n|\\r\\n|\\n)[\x20\t]*([A-Za-z0-9+/_-]+={0,2})")
JOINT = re.compile(r"[/_-]")
"""Base64 characters that may also join a name to the token behind it."""
LEAST_TOKEN = 16
RUN = re.compile(r"""[A-Za-z0-9+/_.=:"'\x20%\\&#;-]*""")
"""Characters that secrets, escapes and tokens consist of: text may be cut at any other, in each layer of it."""
CHUNK = 1 << 20
WINDOW = 1 << 22
"""Characters of a decoded stream that are scanned at a time."""
MAX_RUN = 1 << 25
"""Characters of a decoded stream without a place to cut that are held; ``unread`` counts longer runs, which are cut with an overlap."""
DEPTH = 8
"""Escapes of escapes up to this depth give a layer each; what is deeper is resolved to its end in one layer."""
NESTED = 100
"""Compressed streams inside each other that are opened; ``unread`` counts what is beyond."""
HEAD = 1 << 16
"""Bytes by which a compressed stream that holds itself is recognised."""


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets in a text, by start, then kind."""
    found = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(hint in low for hint in HINTS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A decoded text and where its characters come from: runs of (start here, start and end in the document).

    ``step`` is 1 where characters stand one to one for those of the document, 0 where a run stands as a whole.
    """

    def __init__(self, text: str, runs, path: str, depth: int = 0):
        self.text, self.runs, self.path, self.depth = text, runs, path, depth
        self.starts = [r[0] for r in runs]

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The span of the document that the characters start..end come from."""
        a = self.runs[bisect.bisect_right(self.starts, start) - 1]
        b = self.runs[bisect.bisect_right(self.starts, end - 1) - 1]
        low = a[1] + (start - a[0] if a[3] else 0)
        high = b[1] + (end - b[0]) if b[3] else b[2]
        return low, high


def _rebuilt(layer: Layer, pieces, path: str) -> Layer | None:
    """The layer with some of its spans replaced: ``pieces`` are (start, end, text), in order."""
    if not pieces:
        return None
    parts, runs, at, size = [], [], 0, 0

    def plain(start, end):
        nonlocal size
        if start == end:
            return
        parts.append(layer.text[start:end])
        i = bisect.bisect_right(layer.starts, start) - 1
        while i < len(layer.runs) and layer.runs[i][0] < end:
            first = max(start, layer.runs[i][0])
            here = layer.runs[i]
            runs.append((size + first - start, here[1] + (first - here[0] if here[3] else 0), here[2], here[3]))
            i += 1
        size += end - start

    for start, end, text in pieces:
        plain(at, start)
        if text:
            runs.append((size, *layer.origin(start, end), 0))
            parts.append(text)
            size += len(text)
        at = end
    plain(at, len(layer.text))
    return Layer("".join(parts), runs, path, layer.depth + 1) if runs else None


def _url(layer: Layer):
    if "%" not in layer.text:
        return None
    pieces = []
    for m in URL_ESCAPE.finditer(layer.text):
        at = m.start()
        for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
            if "\udc80" <= c <= "\udcff":  # a byte that is no UTF-8 stays as it is
                at += 3
                continue
            width = 3 * len(c.encode())
            pieces.append((at, at + width, c))
            at += width
    return _rebuilt(layer, pieces, layer.path + "url/")


def _code_point(m) -> str | None:
    value = int(m[1] or m[2] or m[3], 16) if m[4] is None else int(m[4])
    return chr(value) if value < 0x110000 and not 0xD800 <= value < 0xE000 else None


def _unicode(layer: Layer):
    if "\\" not in layer.text and "&#" not in layer.text:
        return None
    pieces, last = [], None
    for m in UNICODE_ESCAPE.finditer(layer.text):
        value = int(m[1], 16) if m[1] else 0
        if last and 0xDC00 <= value < 0xE000 and last[1] == m.start():  # the second half of a pair
            pieces.append((last[0], m.end(), chr(0x10000 + ((last[2] - 0xD800) << 10) + value - 0xDC00)))
        elif (c := _code_point(m)) is not None:
            pieces.append((m.start(), m.end(), c))
        last = (m.start(), m.end(), value) if 0xD800 <= value < 0xDC00 else None
    return _rebuilt(layer, pieces, layer.path + "unicode/")


class _Resolved:
    """Text whose escapes are resolved while it is put together, so that a result can be part of the next escape."""

    def __init__(self, layer: Layer):
        self.layer, self.parts, self.runs, self.size = layer, [], [], 0
        self.tail: list[tuple[str, int, int]] = []  # (character, start and end in the layer) that an escape may still take
        self.changed = False

    def _settle(self, keep: int):
        """Moves all but the last ``keep`` characters of the tail to the result."""
        done, self.tail = self.tail[:max(0, len(self.tail) - keep)], self.tail[max(0, len(self.tail) - keep):]
        for c, start, end in done:
            if "\ud800" <= c <= "\udfff" and end - start > 1:  # half a pair, or a byte that is no UTF-8, stays as it was
                c = self.layer.text[start:end]
            self.copy(start, end, c)

    def copy(self, start: int, end: int, text: str):
        plain = len(text) == end - start
        low, high = self.layer.origin(start, end)
        if plain and high - low == end - start:
            if self.runs and self.runs[-1][3] and self.runs[-1][2] == low:
                self.runs[-1] = (self.runs[-1][0], self.runs[-1][1], high, 1)
            else:
                self.runs.append((self.size, low, high, 1))
        else:
            self.runs.append((self.size, low, high, 0))
        self.parts.append(text)
        self.size += len(text)

    def _completed(self, c: str) -> str | None:
        """The escape that the last character of the tail completes."""
        tail = self.tail
        if c in HEX_DIGITS:
            at = len(tail)
            if at > 2 and tail[at - 3][0] == "%":
                return f"%{tail[at - 2][0]}{c}" if tail[at - 2][0] in HEX_DIGITS else None
            if not (at > 3 and tail[at - 4][0] == "\\" or at > 5 and tail[at - 6][0] == "\\"):
                return None
        elif c != ";":
            return None
        found = ESCAPE_ENDS.search("".join([t[0] for t in tail[-LONGEST_ESCAPE:]]))
        return found and found[0]

    def add(self, c: str, start: int, end: int):
        """Appends a character and resolves what it completes, again and again."""
        tail = self.tail
        while True:
            tail.append((c, start, end))
            code = self._completed(c)
            if not code:
                break
            value = int(code[1:], 16) if code[0] == "%" else int(code[2:], 16) if code[0] == "\\" else int(
                code[3:-1], 16) if code[2] == "x" else int(code[2:-1])
            if code[0] == "&" and (value >= 0x110000 or 0xD800 <= value < 0xE000):
                break
            start = tail[-len(code)][1]
            del tail[-len(code):]
            self.changed = True
            c = chr(value) if code[0] != "%" or value < 0x80 else chr(0xDC00 + value)
            if code[0] == "\\" and 0xDC00 <= value < 0xE000 and tail and "\ud800" <= tail[-1][0] < "\udc00":
                high, start, _ = tail.pop()
                c = chr(0x10000 + ((ord(high) - 0xD800) << 10) + value - 0xDC00)
            elif code[0] == "%" and value >= 0x80:
                c, start = self._character(c, start, end)
        if c not in ESCAPE_BODY and not "\ud800" <= c <= "\udfff":
            self._settle(0)
        elif len(tail) > 4 * LONGEST_ESCAPE:
            begun = any(t[0] in "%\\&" or "\ud800" <= t[0] <= "\udfff" for t in tail[-LONGEST_ESCAPE:])
            self._settle(2 * LONGEST_ESCAPE if begun else 0)

    def _character(self, c: str, start: int, end: int) -> tuple[str, int]:
        """The character that bytes before and this one make up, or the byte."""
        for n in range(1, 4):
            before = self.tail[-n:]
            if len(before) < n or not all("\udc80" <= t[0] <= "\udcff" for t in before):
                break
            try:
                found = ("".join([t[0] for t in before]) + c).encode("utf-8", "surrogateescape").decode()
            except UnicodeDecodeError:
                continue
            del self.tail[-n:]
            return found, before[0][1]
        return c, start


def _resolved(layer: Layer) -> Layer | None:
    """The layer with all escapes resolved to the end, whatever their depth, in one pass."""
    out, text, at = _Resolved(layer), layer.text, 0
    while at < len(text):
        if not out.tail:
            found = ESCAPE_BEGINS.search(text, at)
            end = found.start() if found else len(text)
            if end > at:
                out.copy(at, end, text[at:end])
                at = end
                continue
        out.add(text[at], at, at + 1)
        at += 1
    out._settle(0)
    if not out.changed or not out.runs:
        return None
    return Layer("".join(out.parts), out.runs, layer.path + "escapes/", layer.depth + 1)


def _compressed(raw: bytes) -> bool:
    """Whether bytes start like gzip or zlib data."""
    return raw[:2] == b"\x1f\x8b" or (raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] * 256 + raw[1]) % 31 == 0)


class _Member:
    """The first compressed member of a stream of bytes, inflated in chunks; ``rest`` is the stream behind it."""

    def __init__(self, chunks):
        self.chunks, self.unwrap, self.rest = chunks, zlib.decompressobj(47), None
        self.held: list[bytes] = []
        self.out = self._inflated()
        self.first = next(self.out, b"")
        self.broken = not self.first and self.rest is None

    def _inflated(self):
        began = False
        for chunk in self.chunks:
            if not began:
                self.held.append(chunk)
            while chunk and not self.unwrap.eof:
                try:
                    found = self.unwrap.decompress(chunk, CHUNK)
                except zlib.error:
                    return
                chunk = self.unwrap.unconsumed_tail
                if found:
                    began, self.held = True, self.held if not began else []
                    yield found
            if self.unwrap.eof:
                self.rest = itertools.chain([self.unwrap.unused_data] if self.unwrap.unused_data else [], self.chunks)
                return
        while not self.unwrap.eof and (found := self.unwrap.decompress(b"", CHUNK)):
            yield found

    def __iter__(self):
        yield self.first
        self.held = []
        yield from self.out


def _windows(chunks):
    """Bytes as text in windows: (text, whether a run was cut). Other cuts are where no secret, escape or token is split."""
    decoder, text, limit = codecs.getincrementaldecoder("utf-8")("replace"), "", WINDOW
    for chunk in chunks:
        text += decoder.decode(chunk)
        if len(text) < limit:
            continue
        cut = len(text) - RUN.match(text[::-1]).end()
        if cut:
            yield text[:cut], False
            text, limit = text[cut:], WINDOW
        elif len(text) >= MAX_RUN:
            yield text, True
            text, limit = text[-WINDOW // 4:], WINDOW
        limit = max(limit, 2 * len(text))
    text += decoder.decode(b"", True)
    if text:
        yield text, False


def _opened(chunks, span, path: str, heads=()):
    """Layers of the text in a stream of bytes, compressed streams in it opened as they are read, member by member.

    A stream inside a stream is read while the outer one is, so nothing is held but a chunk of each. 1 comes in place of
    what is beyond the bounds, and of a stream that holds itself.
    """
    chunks = iter(chunks)
    while True:
        head = b""
        while len(head) < 3 and (chunk := next(chunks, None)) is not None:
            head += chunk
        if not head:
            return
        chunks = itertools.chain([head], chunks)
        member = None
        if _compressed(head):
            again = any(h[:len(head)] == head[:len(h)] for h in heads)
            if again or len(heads) >= NESTED:
                yield 1
                return
            member = _Member(chunks)
        if member is None or member.broken:
            for text, cut in _windows(itertools.chain(member.held, chunks) if member else chunks):
                yield Layer(text, [(0, *span, 0)], path)
                if cut:
                    yield 1
            return
        inside = iter(member)
        yield from _opened(inside, span, path + "zlib/", (*heads, head[:HEAD]))
        for _ in inside:  # what was not read of the member
            pass
        if member.rest is None:
            return
        chunks = member.rest


def _in_chunks(raw: bytes):
    return (raw[at:at + CHUNK] for at in range(0, len(raw), CHUNK))


def _decoded(token: str):
    """(place, bytes) of a run of base64 characters: from its start, and from behind characters that may join a name to a token.

    Tokens that begin at the same place modulo 4 share their bytes, so there are four to decode at most; one that is
    compressed is given by itself.
    """
    starts: dict[int, list[int]] = {0: [0]}
    for m in JOINT.finditer(token):
        if len(token) - m.end() >= LEAST_TOKEN:
            starts.setdefault(m.end() % 4, []).append(m.end())
    for places in starts.values():
        body = token[places[0]:].rstrip("=").replace("-", "+").replace("_", "/")
        body = body[:-1] if len(body) % 4 == 1 else body
        raw = base64.b64decode(body + "=" * (-len(body) % 4))
        yield places[0], raw
        for place in places[1:]:
            at = (place - places[0]) // 4 * 3
            if _compressed(raw[at:at + 3]):
                yield place, raw[at:]


def _tokens(layer: Layer):
    """Streams of layers, one for each base64 token; lines of equal length, and a shorter last one, are one token too."""
    path = layer.path + "base64/"
    for m in BASE64.finditer(layer.text):
        for place, raw in _decoded(m[0]):
            yield _opened(_in_chunks(raw), layer.origin(m.start() + place, m.end()), path)
    for m in BASE64_LINES.finditer(layer.text):
        lines = [(m.start() + x.start(1), x[1]) for x in BASE64_LINE.finditer(m[0])]
        first = 0
        while first < len(lines) - 1:
            width, last = len(lines[first][1]), first + 1
            while last < len(lines) and len(lines[last][1]) == width and "=" not in lines[last - 1][1]:
                last += 1
            if last < len(lines) and len(lines[last][1]) < width and "=" not in lines[last - 1][1]:
                last += 1
            if last - first > 1 and width >= LEAST_TOKEN:
                end = lines[last - 1][0] + len(lines[last - 1][1])
                for place, raw in _decoded("".join([line for _, line in lines[first:last]])):
                    start = lines[first + place // width][0] + place % width
                    yield _opened(_in_chunks(raw), layer.origin(start, end), path)
            first = max(last - 1, first + 1) if last < len(lines) else len(lines)


def find(text: str | None) -> tuple[list, list, int]:
    """Base spans, all spans as (start, kind, end, layer), and the number of layers that were not read to their end.

    A worklist starts with the text. Each layer is scanned; what its URL escapes, Unicode escapes, base64 tokens and compressed
    tokens unwrap to joins the list unless the same text from the same place was there before, so cycles end. Escapes of
    escapes are layers of their own up to ``DEPTH``; deeper ones are resolved to their end in one pass. Tokens are unwrapped
    one by one, and long ones in windows, each with all that is under it before the next. Bytes that are no text are scanned for
    what is readable in them. A span found in a layer is that of the characters it comes from; for base64 and
    compressed layers that of the whole token.
    """
    if not text:
        return [], [], 0
    base = scan(text)
    spans = {(s, k, e): "" for s, k, e in base}
    root = Layer(text, [(0, 0, len(text), 1)], "")
    seen, work, unread = {(hash(text), 0)}, [root], 0

    def push(layer):
        if layer and (mark := (hash(layer.text), layer.runs[0][1])) not in seen:
            seen.add(mark)
            work.append(layer)

    while work:
        item = work.pop()
        if not isinstance(item, Layer):
            found = next(item, None)
            if found is not None:
                work.append(item)
                if found == 1:
                    unread += 1
                elif isinstance(found, Layer):
                    push(found)
                else:
                    work.append(found)
            continue
        if item is not root:
            for start, kind, end in scan(item.text):
                low, high = item.origin(start, end)
                spans.setdefault((low, kind, high), item.path)
        if item.depth < DEPTH:
            push(_url(item))
            push(_unicode(item))
        elif item.depth == DEPTH:
            push(_resolved(item))
        work.append(_tokens(item))
    return base, sorted((s, k, e, path) for (s, k, e), path in spans.items()), unread


def _joined(spans) -> str:
    return ",".join([f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans])


def scan_documents(docs: DataFrame, text: str = "text", carry=None) -> DataFrame:
    """Adds the counts of base spans per kind, ``base_spans`` and ``spans`` as text, ``layers`` and ``unread``.

    Base spans are matches in the text itself; ``spans`` adds those of the unwrapped layers, as kind:start:end in
    code points of the text, by start, then kind, without repeats. ``layers`` names for each span the
    encodings it was under (empty for base spans). ``unread`` counts runs of a compressed layer longer than ``MAX_RUN`` and
    streams nested deeper than ``NESTED`` or in themselves; no text is cut.

    Null and empty texts have no spans. Whole texts are scanned where they lie, in bounded batches; no shuffle. Input columns
    named like a result give way to it.
    """
    fields = [("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_spans", "string"), ("spans", "string"),
              ("layers", "string"), ("unread", "bigint")]

    def make():
        def step(texts):
            found = [find(t) for t in texts]
            counts = [[sum(s[1] == k for s in base) for base, _, _ in found] for k in range(len(KINDS))]
            return [*counts, [_joined(base) for base, _, _ in found], [_joined(spans) for _, spans, _ in found],
                    [",".join([s[3] for s in spans]) for _, spans, _ in found], [unread for _, _, unread in found]]
        return step

    return annotate(docs, text, fields, make, carry)


def with_digests(scanned: DataFrame) -> DataFrame:
    """Adds ``base_sha256``, the digest of the base spans."""
    return scanned.withColumn("base_sha256", F.sha2("base_spans", 256))
