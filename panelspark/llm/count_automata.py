"""Weighted acyclic automata over word strings: built from sorted strings, united with summed weights, composed for lookups."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import arrays as A


def encode(words: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The sorted distinct words and every word's place among them."""
    coded = words.dictionary_encode()
    alphabet = coded.dictionary.to_pylist()
    order = sorted(range(len(alphabet)), key=alphabet.__getitem__)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return [alphabet[i] for i in order], rank[coded.indices.to_numpy(zero_copy_only=False)] if len(order) else np.zeros(0, np.int32)


def word_array(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    borders = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(A.gather(raw, start, end)))]
    )


@dataclass(frozen=True)
class Automaton:
    """States by depth, in the order of their strings; ``weight`` is that of the string that ends in a state.

    A string is one of words ``alphabet[label]``. States of a depth are sorted by (parent, label), so a transition is a
    binary search. The states that no string leaves are one final state, which needs no entry.
    """

    alphabet: list[bytes]
    parent: list[np.ndarray]
    label: list[np.ndarray]
    weight: list[np.ndarray]

    @classmethod
    def build(cls, alphabet: list[bytes], strings: np.ndarray, weight: np.ndarray) -> Automaton:
        """From rows of labels, -1 behind the end of shorter ones, in any order; equal rows add up.

        Rows are sorted; a row opens states behind the prefix that it shares with the row before it, as in the incremental
        construction from sorted strings.
        """
        depth = strings.shape[1]
        order = np.lexsort(strings.T[::-1])
        rows, weight = strings[order], weight[order]
        opens = np.zeros(len(rows), np.bool_)
        opens[:1] = True
        states = np.zeros(len(rows), np.int64)
        parents, labels, weights = [], [], []
        for d in range(depth):
            opens = opens.copy()
            opens[1:] |= rows[1:, d] != rows[:-1, d]
            real = rows[:, d] >= 0
            first = np.flatnonzero(opens & real)
            parents.append(states[first].astype(np.int32))
            labels.append(rows[first, d].astype(np.int32))
            states = np.cumsum(opens & real) - 1
            ends = real & (rows[:, d + 1] < 0 if d + 1 < depth else True)
            weights.append(np.bincount(states[ends], weight[ends], len(first)).astype(np.int64) if len(first) else np.zeros(0, np.int64))
        return cls(alphabet, parents, labels, weights)

    def strings(self) -> tuple[np.ndarray, np.ndarray]:
        """All states as rows of labels with the weight of the string that ends there (0 too)."""
        depth, rows, out, weights = len(self.label), np.zeros((1, 0), np.int32), [], []
        for d in range(depth):
            if not len(self.label[d]):
                break
            rows = np.hstack([rows[self.parent[d]], self.label[d][:, None]])
            out.append(np.hstack([rows, np.full((len(rows), depth - d - 1), -1, np.int32)]))
            weights.append(self.weight[d])
        return (np.vstack(out), np.concatenate(weights)) if out else (np.zeros((0, depth), np.int32), np.zeros(0, np.int64))

    def totals(self, above: int) -> list[np.ndarray]:
        """The weight of all strings that begin with a state's string, for states deeper than ``above``; else its own."""
        out = [w.copy() for w in self.weight]
        for d in range(len(out) - 1, above, -1):
            np.add.at(out[d - 1], self.parent[d], out[d])
        return out

    @classmethod
    def union(cls, parts: list[Automaton]) -> Automaton:
        """One automaton of all strings of the parts, with the sums of their weights."""
        words = pa.array([w for p in parts for w in p.alphabet], pa.large_binary())
        alphabet, code = encode(words)
        rows, weights, at = [], [], 0
        for p in parts:
            own = np.append(code[at : at + len(p.alphabet)], np.int32(-1))
            at += len(p.alphabet)
            strings, weight = p.strings()
            rows.append(own[strings][weight > 0])
            weights.append(weight[weight > 0])
        return cls.build(alphabet, np.vstack(rows), np.concatenate(weights))

    def compose(self, asked: Automaton) -> list[np.ndarray]:
        """The states of ``self`` that the states of ``asked`` meet, by depth; -1 where there is none."""
        known = {w: i for i, w in enumerate(self.alphabet)}
        code = np.array([known.get(w, -1) for w in asked.alphabet], np.int64)
        met, out = np.zeros(1, np.int64), []
        for d in range(len(asked.label)):
            if d >= len(self.label) or not len(self.label[d]) or not len(asked.label[d]):
                out.append(np.full(len(asked.label[d]), -1, np.int64))
                met = out[-1]
                continue
            size = len(self.alphabet)
            arcs = self.parent[d].astype(np.int64) * size + self.label[d]
            before, label = met[asked.parent[d]], code[asked.label[d]]
            wanted = before * size + label
            place = np.minimum(np.searchsorted(arcs, wanted), len(arcs) - 1)
            met = np.where((before >= 0) & (label >= 0) & (arcs[place] == wanted), place, -1)
            out.append(met)
        return out

    def pack(self) -> tuple[bytes, bytes, bytes]:
        """Words (lengths, then bytes), shape (states of each depth) and states as bytes."""
        sizes = np.array([len(w) for w in self.alphabet], np.uint32)
        shape = np.array([len(sizes), *(len(x) for x in self.label)], np.uint32)
        states = b"".join(x.tobytes() for d in range(len(self.label)) for x in (self.parent[d], self.label[d], self.weight[d]))
        return sizes.tobytes() + b"".join(self.alphabet), shape.tobytes(), states

    @classmethod
    def unpack(cls, words: bytes, shape: bytes, states: bytes) -> Automaton:
        n, *sizes = np.frombuffer(shape, np.uint32).tolist()
        ends = np.cumsum(np.frombuffer(words, np.uint32, n), dtype=np.int64)
        text = words[4 * n :]
        alphabet = [text[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())]
        parent, label, weight, at = [], [], [], 0
        for size in sizes:
            for into, kind in ((parent, np.int32), (label, np.int32), (weight, np.int64)):
                into.append(np.frombuffer(states, kind, size, at))
                at += size * np.dtype(kind).itemsize
        return cls(alphabet, parent, label, weight)
