"""Double-array tries over integer symbols, built and walked with numpy.

A state ``s`` moves on symbol ``c`` to ``t = base[s] + c`` if ``check[t] == s``.
``walk`` advances all positions of a text together, one level at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np

from tillroll.llm.chunks import expand, squeeze

_TRIES = 4096  # places tried at once for a state with several children


class DoubleArray:
    """``accept[s]`` is the row of ``paths`` that ends in state ``s``, or -1."""

    def __init__(self, base: np.ndarray, check: np.ndarray, accept: np.ndarray):
        self.base, self.check, self.accept = base, check, accept

    @classmethod
    def build(cls, paths: np.ndarray) -> DoubleArray:
        """``paths``: distinct rows of symbols (0 or more), padded by -1 at the end."""
        parents, symbols, ends = _nodes(paths)
        n = len(parents)
        order = np.argsort(parents[1:], kind="stable") + 1  # children, by parent
        first = np.searchsorted(parents[order], np.arange(n + 1))
        size = first[1:] - first[:-1]
        slots = _Slots(2 * n + int(symbols.max(initial=0)) + 2)
        at = np.zeros(n, dtype=np.int64)  # state of a node
        bases = np.zeros(n, dtype=np.int64)  # of a node
        rng = np.random.default_rng(0)
        for node in np.argsort(-size, kind="stable")[: int((size > 1).sum())].tolist():
            kids = order[first[node] : first[node + 1]]
            bases[node] = b = slots.place(symbols[kids], rng)
            at[kids] = b + symbols[kids]
        single = np.flatnonzero(size == 1)  # any free slot will do
        kids = order[first[single]]
        at[kids] = slots.free(len(single))
        bases[single] = at[kids] - symbols[kids]
        top = len(slots.used)
        base, check, accept = np.zeros(top, dtype=np.int32), np.full(top, -1, dtype=np.int32), np.full(top, -1, dtype=np.int32)
        base[at] = bases
        check[at[1:]] = at[parents[1:]]
        accept[at[ends]] = np.arange(len(paths))
        return cls(base, check, accept)

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Next states; -1 where there is no move (or the symbol is negative)."""
        t = self.base[states] + symbols
        ok = (symbols >= 0) & (t > 0) & (t < len(self.check))
        t = np.where(ok, t, 0)
        return np.where(ok & (self.check[t] == states), t, -1)

    def walk(self, state: int, text: np.ndarray, starts: int, depth: int) -> Iterator[np.ndarray]:
        """For each level: the states reached after that many symbols from the
        positions below ``starts`` that still have one."""
        text = np.concatenate([text, np.full(depth, -1, dtype=text.dtype)])
        pos, s = np.arange(starts), np.full(starts, state, dtype=np.int32)
        for level in range(depth):
            s = self.step(s, text[pos + level])
            live = s >= 0
            pos, s = pos[live], s[live]
            yield s

    def to_bytes(self, words: list[bytes]) -> bytes:
        return squeeze(pickle.dumps((self.base, self.check, self.accept, words), protocol=5))

    @classmethod
    def from_bytes(cls, b: bytes) -> tuple[DoubleArray, list[bytes]]:
        *arrays, words = pickle.loads(expand(b))
        return cls(*arrays), words


def _nodes(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parent, symbol) of every node, the root first; the last node of each path."""
    parents, symbols = [np.array([-1])], [np.array([0])]
    now = np.zeros(len(paths), dtype=np.int64)
    width = int(paths.max(initial=0)) + 1
    total = 1
    for d in range(paths.shape[1]):
        rows = np.flatnonzero(paths[:, d] >= 0)
        codes, which = np.unique(now[rows] * width + paths[rows, d], return_inverse=True)
        parents.append(codes // width)
        symbols.append(codes % width)
        now[rows] = total + which
        total += len(codes)
    return np.concatenate(parents), np.concatenate(symbols), now


class _Slots:
    def __init__(self, n: int):
        self.used = np.zeros(n, dtype=bool)
        self.used[0] = True  # the root

    def _grow(self, n: int) -> None:
        if n > len(self.used):
            self.used = np.concatenate([self.used, np.zeros(max(n - len(self.used), len(self.used) // 4), dtype=bool)])

    def place(self, symbols: np.ndarray, rng: np.random.Generator) -> int:
        """A base at which all symbols meet free slots (taken)."""
        lo, hi = int(symbols.min()), int(symbols.max())
        room = max(1, len(self.used) - (hi - lo))
        for tries in (16, 256, _TRIES):
            at = rng.integers(1, room, size=min(tries, max(1, 4_000_000 // len(symbols)))) - lo if room > 1 else np.array([1 - lo])
            ok = ~self.used[at[:, None] + symbols[None, :]].any(axis=1)
            if ok.any():
                b = int(at[np.argmax(ok)])
                break
        else:  # behind all others
            b = int(np.flatnonzero(self.used)[-1]) + 1 - lo
            self._grow(b + hi + 1)
        self.used[b + symbols] = True
        return b

    def free(self, n: int) -> np.ndarray:
        at = np.flatnonzero(~self.used)
        if len(at) < n:
            self._grow(len(self.used) + n - len(at))
            at = np.flatnonzero(~self.used)
        self.used[at[:n]] = True
        return at[:n]
