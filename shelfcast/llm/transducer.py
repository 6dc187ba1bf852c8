"""Minimal acyclic transducer from byte strings to word numbers.

Words are added in order; a finished state is replaced by an equal one, so
suffixes are shared. Each arc carries how many words lie before its target, so
the outputs along a path add up to the word's number, and the number leads to
the word's token ids. The arrays are stored in one file image that workers map
into memory.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import tempfile

import numpy as np

_PARTS = (("keys", np.int64), ("target", np.int32), ("skip", np.int32), ("final", np.uint8),
          ("offsets", np.int64), ("ids", np.int32))


def build(words: list[bytes], outputs: list[bytes]) -> dict[str, np.ndarray]:
    """Arrays of the transducer for sorted, distinct words and their token ids
    (little-endian 32-bit integers)."""
    register: dict = {}
    arcs_of: list[list[tuple[int, int]]] = []      # per finished state: (byte, state)
    final_of: list[bool] = []
    size_of: list[int] = []                        # words from the state on

    def finish(node) -> int:
        arcs, final = node
        sign = (final, tuple(arcs))
        state = register.get(sign)
        if state is None:
            state = register[sign] = len(arcs_of)
            arcs_of.append(arcs)
            final_of.append(final)
            size_of.append(int(final) + sum(size_of[s] for _, s in arcs))
        return state

    path: list = [([], False)]                     # open states along the last word
    last = b""
    for word in words:
        same = 0
        for same, (x, y) in enumerate(zip(last, word)):  # noqa: B007
            if x != y:
                break
        else:
            same = min(len(last), len(word))
        while len(path) > same + 1:
            node = path.pop()
            path[-1][0].append((last[len(path) - 1], finish(node)))
        for _ in range(len(word) - same):
            path.append(([], False))
        path[-1] = (path[-1][0], True)
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][0].append((last[len(path) - 1], finish(node)))
    root = finish(path[0])
    keys, target, skip = [], [], []
    # States are numbered so that the root is 0 and arcs lie in key order.
    order = [root, *(s for s in range(len(arcs_of)) if s != root)]
    number = {s: i for i, s in enumerate(order)}
    for s in order:
        before = int(final_of[s])
        for byte, t in arcs_of[s]:
            keys.append(number[s] << 8 | byte)
            target.append(number[t])
            skip.append(before)
            before += size_of[t]
    lengths = [len(x) // 4 for x in outputs]
    values = {"keys": keys, "target": target, "skip": skip, "final": [final_of[s] for s in order],
              "offsets": np.concatenate([[0], np.cumsum(lengths)]) if lengths else [0],
              "ids": np.frombuffer(b"".join(outputs), "<i4")}
    return {k: np.asarray(values[k], t) for k, t in _PARTS}


def image(arrays: dict[str, np.ndarray]) -> bytes:
    """File image: the parts' lengths, then the parts, each on 8 bytes."""
    head = np.array([len(arrays[k]) for k, _ in _PARTS], "<i8").tobytes()
    return head + b"".join(x + bytes(-len(x) % 8) for x in (arrays[k].tobytes() for k, _ in _PARTS))


class Lexicon:
    """A transducer mapped into memory from its image."""

    def __init__(self, data: bytes):
        name = os.path.join(tempfile.gettempdir(), f"lexicon-{hashlib.sha256(data).hexdigest()[:32]}.fst")
        if not os.path.exists(name):
            handle, part = tempfile.mkstemp(dir=tempfile.gettempdir())
            with os.fdopen(handle, "wb") as f:
                f.write(data)
            os.replace(part, name)
        with open(name, "rb") as f:
            whole = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)
        sizes = whole[:8 * len(_PARTS)].view("<i8")
        at = 8 * len(_PARTS)
        for (part, kind), n in zip(_PARTS, sizes.tolist()):
            width = n * np.dtype(kind).itemsize
            setattr(self, part, whole[at:at + width].view(kind))
            at += width + -width % 8

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 if it is not in the lexicon. All words
        step through the automaton together."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        text = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        alive = np.arange(n) if len(self.keys) else np.zeros(0, np.int64)
        out = np.full(n, -1, np.int64)
        step = 0
        while len(alive):
            over = lengths[alive] == step
            done = alive[over]
            done = done[self.final[state[done]] == 1]
            out[done] = total[done]
            alive = alive[~over]
            key = state[alive] << 8 | text[starts[alive] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            alive, arc = alive[ok], arc[ok]
            state[alive] = self.target[arc]
            total[alive] += self.skip[arc]
            step += 1
        return out

    def ids_of(self, number: int) -> bytes:
        return self.ids[self.offsets[number]:self.offsets[number + 1]].tobytes()
