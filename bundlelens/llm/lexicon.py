"""A minimal acyclic transducer from words to token ids, as one file that workers map into memory.

Words are byte strings. Arcs carry numbers whose sum along a word's path is the word's place in a table
of id sequences, so equal endings share their states whatever their ids are.
"""

from __future__ import annotations

import json
import mmap

import numpy as np

ALIGN = 8
WIDEST = 48
"""Bytes of the longest word that a lexicon holds."""


def _automaton(words: list[bytes]):
    """The minimal automaton of sorted distinct words: per state its arcs {byte: state} and whether it is final.

    States are merged from the end of each finished branch with an equal one made before.
    """
    register: dict[tuple, int] = {}
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    path = [0]
    last = b""

    def close(depth):
        while len(path) - 1 > depth:
            state = path.pop()
            same = register.setdefault((final[state], tuple(arcs[state].items())), state)
            if same != state:
                arcs[path[-1]][last[len(path) - 1]] = same
                free.append(state)

    free: list[int] = []
    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        close(shared)
        for byte in word[shared:]:
            if free:
                state = free.pop()
                arcs[state], final[state] = {}, False
            else:
                state = len(arcs)
                arcs.append({})
                final.append(False)
            arcs[path[-1]][byte] = state
            path.append(state)
        final[path[-1]] = True
        last = word
    close(0)
    return arcs, final


def compile_lexicon(entries: dict[bytes, bytes]) -> bytes:
    """The file for a dictionary of words and their ids (32-bit numbers, packed); words over ``WIDEST`` bytes or with zero bytes are left out."""
    words = sorted(w for w in entries if 0 < len(w) <= WIDEST and 0 not in w)
    arcs, final = _automaton(words)
    order, seen, stack = [], {0}, [(0, iter(arcs[0].values()))]
    while stack:  # children before parents, without recursion
        state, children = stack[-1]
        child = next((c for c in children if c not in seen), None)
        if child is None:
            order.append(state)
            stack.pop()
        else:
            seen.add(child)
            stack.append((child, iter(arcs[child].values())))
    count = [0] * len(arcs)
    for state in order:
        count[state] = int(final[state]) + sum(count[c] for c in arcs[state].values())
    number = {state: i for i, state in enumerate(reversed(order))}
    labels, targets, outputs, finals = [], [], [], []
    for state in reversed(order):
        output = int(final[state])
        finals.append(final[state])
        for byte, child in sorted(arcs[state].items()):
            labels.append(number[state] << 8 | byte)
            targets.append(number[child])
            outputs.append(output)
            output += count[child]
    offsets = np.cumsum([0] + [len(entries[w]) // 4 for w in words])
    parts = {
        "labels": np.array(labels, "<u8"), "targets": np.array(targets, "<u4"),
        "outputs": np.array(outputs, "<u4"), "finals": np.array(finals, "u1"), "offsets": offsets.astype("<u4"),
        "ids": np.frombuffer(b"".join(entries[w] for w in words), "<u4"),
    }
    index, body = {}, b""
    for name, values in parts.items():
        body += b"\0" * (-len(body) % ALIGN)
        index[name] = [values.dtype.str, len(body), len(values)]
        body += values.tobytes()
    head = json.dumps(index).encode()
    head += b" " * (-(len(head) + 8) % ALIGN)
    return len(head).to_bytes(8, "little") + head + body


class Lexicon:
    """A compiled file, mapped into memory. Arcs are sorted by their state and byte."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        size = int.from_bytes(data[:8], "little")
        for name, (kind, at, count) in json.loads(data[8:8 + size]).items():
            setattr(self, name, np.frombuffer(data, kind, count, 8 + size + at))

    def __len__(self):
        return len(self.offsets) - 1

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the table of ids, or -1. All words walk the automaton side by side."""
        found = np.full(len(words), -1, np.int64)
        if not words or not len(self):
            return found
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        active = np.flatnonzero(sizes <= WIDEST)
        letters = np.array([words[i] for i in active.tolist()], f"S{WIDEST}").view(np.uint8).reshape(len(active), WIDEST)
        state, place, step = np.zeros(len(active), np.int64), np.zeros(len(active), np.int64), 0
        while len(active):
            done = sizes[active] == step
            if done.any():
                ended = done & (self.finals[state] == 1)
                found[active[ended]] = place[ended]
                active, state, place, letters = active[~done], state[~done], place[~done], letters[~done]
                if not len(active):
                    break
            keys = ((state << 8) | letters[:, step]).astype(np.uint64)
            at = np.minimum(np.searchsorted(self.labels, keys), len(self.labels) - 1)
            on = self.labels[at] == keys
            at, active, letters = at[on], active[on], letters[on]
            state, place = self.targets[at].astype(np.int64), place[on] + self.outputs[at]
            step += 1
        return found

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word as little-endian 32-bit numbers; None for words that the lexicon doesn't hold."""
        places, ids = self.places(words), self.ids
        held = places >= 0
        starts, ends = (self.offsets[np.where(held, places + i, 0)].tolist() for i in (0, 1))
        return [ids[a:b].tobytes() if p else None for p, a, b in zip(held.tolist(), starts, ends)]
