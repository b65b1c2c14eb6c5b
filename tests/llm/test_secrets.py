"""Operator 10: base spans against a plain scanner, chains of escapes against layers, tokens in lines and behind names, streams in streams."""

import base64
import gzip
import random
import time
import zlib

import pytest

from bundlelens.llm import secrets

ACCESS = "AKIA" + "B" * 16
VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_scan(text):
    """Base spans by hand: leftmost matches one after the other, greedy as the patterns are."""
    found, low, at = [], ascii_lower(text), 0
    while at < len(text):
        word = next((w for w in WORDS if low.startswith(w, at)), None)
        place = at + len(word) if word else None
        end = None
        if word:
            for quote in ((1, 0) if text[place:place + 1] in ("'", '"') and text[place:place + 1] else (0,)):
                i = place + quote
                while text[i:i + 1] == " ":
                    i += 1
                if text[i:i + 1] not in (":", "="):
                    continue
                i += 1
                while text[i:i + 1] == " ":
                    i += 1
                if text[i:i + 1] in ("'", '"') and text[i:i + 1]:
                    i += 1
                end = i
                while end < len(text) and text[end] in VALUE:
                    end += 1
                if end > i:
                    break
                end = None
        if end:
            if end - i >= 6:
                found.append((at, 0, end))
            at = end
        else:
            at += 1
    for kind, head, body, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), (2, "", set("0123456789abcdef"), 24)):
        at = 0
        while at < len(text):
            end = at + len(head)
            if text.startswith(head, at):
                while end < len(text) and text[end] in body:
                    end += 1
            if text.startswith(head, at) and end - at >= least:
                found.append((at, kind, end))
                at = end
            else:
                at += 1
    return sorted(found)


def test_base_spans_against_a_plain_scanner():
    dice = random.Random(7)
    parts = [*WORDS, "Token", "SECRET", "paſſword", "=", ":", " ", "  ", '"', "'", "x", "-", "é", "%", "abcdef", "0" * 9, "AKIA", "B2" * 9,
             "0a1b" * 6, "f" * 23, "\n", ",", "hunter22", "api", "key", "_"]
    for _ in range(4000):
        text = "".join(dice.choices(parts, k=dice.randint(1, 14)))
        assert secrets.find(text)[0] == plain_scan(text), text


def wrapped(dice, text, depth):
    """The text with some of its characters behind escapes, again and again."""
    for _ in range(depth):
        out = []
        for c in text:
            roll = dice.random()
            if roll < 0.08:
                out.append("".join(f"%{b:02X}" for b in c.encode()))
            elif roll < 0.12 and ord(c) < 0x10000:
                out.append(f"\\u{ord(c):04x}")
            elif roll < 0.15 and ord(c) < 256:
                out.append(f"\\x{ord(c):02x}")
            elif roll < 0.18:
                out.append(dice.choice([f"&#{ord(c)};", f"&#x{ord(c):X};"]))
            else:
                out.append(c)
        text = "".join(out)
    return text


def test_few_escapes_are_layers_and_more_end_alike(monkeypatch):
    dice = random.Random(3)
    for n in range(400):
        text = wrapped(dice, dice.choice(["password=hunter22 é", f"x {ACCESS}", "Token: 'a1b2c3d4' 👍", "0a" * 14 + " ÿ"]), dice.randint(0, 3))
        short = secrets.find(text)
        root = secrets.Layer(text, [(0, 0, len(text), 1)], "")
        once = secrets._resolved(root)
        last = root
        while (step := secrets._url(last) or secrets._unicode(last)) is not None:
            last = step
        assert (once.text if once else text) == last.text, text
        ends = [(*last.origin(s, e), k) for s, k, e in secrets.scan(last.text)]
        if once:
            assert [(*once.origin(s, e), k) for s, k, e in secrets.scan(once.text)] == ends, text
        assert {(low, k, high) for low, high, k in ends} <= {s[:3] for s in short[1]}
        monkeypatch.setattr(secrets, "DEPTH", 1000)
        assert secrets.find(text) == short
        monkeypatch.undo()


@pytest.mark.parametrize("chain", ["%" + "25" * 100_000, "&" + "#38;" * 50_000, "%" + "25" * 40_000 + "26" + "#37;26" * 20_000])
def test_long_chains_take_one_pass(chain):
    tail = {"%": "70assword=hunter22", "&": "#112;assword=hunter22"}[chain[0]] if "26" not in chain else "#112;assword=hunter22"
    began = time.perf_counter()
    _, spans, unread = secrets.find(chain + tail)
    assert time.perf_counter() - began < 10 and unread == 0
    assert any(s[1] == 0 and s[2] == len(chain + tail) for s in spans)


def test_wrapped_tokens():
    inner = gzip.compress(("".join(f"line {i} " for i in range(300)) + "password=hunter22 ").encode())
    for token in (base64.encodebytes(inner).decode(), base64.encodebytes(inner).decode().replace("\n", "\r\n    "),
                  base64.encodebytes(inner).decode().replace("\n", "\\n")):
        text = f"-----BEGIN DATA-----\n{token}-----END DATA-----"
        spans = [s for s in secrets.find(text)[1] if s[3]]
        assert [(s[1], s[3]) for s in spans] == [(0, "base64/zlib/")] and text[spans[0][0]:].startswith(token[:40])
        assert text[:spans[0][2]].rstrip().endswith(token.rstrip().rstrip("\\n")[-8:])
    across = base64.encodebytes(b"words before the secret reach over the end, " + ACCESS.encode() + b" and go on behind it").decode()
    assert len(across.split()) == 2 and (0, 1, len(across) - 1) in {s[:3] for s in secrets.find(across)[1]}
    several = base64.encodebytes(b"x" * 57 * 3).decode() + "\n" + base64.encodebytes(b"y" * 50 + b" token=abcdefgh " + b"z" * 60).decode()
    assert any(s[1] == 0 for s in secrets.find(several)[1])


@pytest.mark.parametrize("name", ["blob/", "a/", "id-", "v1_", "x/y/z-", "a-b_c/d-", "/"])
@pytest.mark.parametrize("raw", [b"the password=hunter22 of it", gzip.compress(b"password=hunter22 "), zlib.compress(b"so password=hunter22 ")])
def test_tokens_behind_names(name, raw):
    token = base64.b64encode(raw).decode()
    spans = [s for s in secrets.find(f"see {name}{token} end")[1] if s[3]]
    assert {(s[1], s[2]) for s in spans} == {(0, 4 + len(name + token))}
    assert all(4 <= s[0] <= 4 + len(name) for s in spans)


def test_streams_in_streams_hold_nothing(monkeypatch):
    secret = b"password=hunter22 "
    inner = gzip.compress(b"x, " * 3_000_000 + secret) + gzip.compress(b"AKIA" + b"B" * 16 + b" ")
    token = base64.b64encode(gzip.compress(zlib.compress(inner) + gzip.compress(b"token: abcdefgh"))).decode()
    _, spans, unread = secrets.find(token)
    assert {s[1] for s in spans} == {0, 1} and unread == 0 and {s[2] for s in spans} == {len(token)} and spans[0][0] == 0
    deep = secret
    for _ in range(30):
        deep = gzip.compress(deep)
    assert [s[1] for s in secrets.find(base64.b64encode(deep).decode())[1]] == [0]
    monkeypatch.setattr(secrets, "NESTED", 5)
    assert secrets.find(base64.b64encode(deep).decode())[1:] == ([], 1)
    assert list(secrets._opened([deep], (0, 1), "", (deep,))) == [1]
