"""Weighted acyclic automata over paths of words: count transducers that are built, summed, cut and composed in blocks.

A path is one to ``DEPTH`` words; its last arc carries its count, arcs that only lead on carry 0. Levels hold states as
consecutive blocks of arcs in label order. Sorted paths become levels one by one: a path opens arcs only below the prefix
that it shares with the path before. States with equal arcs are merged from the last level up, so that words which follow
many prefixes with the same counts are kept once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEPTH = 3
_BITS = 21  # a path of three labels in one 64-bit number, up to this many bits a label
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every bit of ``x`` reaches every bit of the result."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, .. (size[0] numbers), first[1], ..."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - first, size)


def path_order(paths: np.ndarray, labels: int) -> np.ndarray:
    """Order of paths (label numbers, -1 after the end): prefixes first, then by label."""
    if labels < (1 << _BITS) - 1:
        return np.argsort(packed(paths), kind="stable")
    return np.lexsort(tuple(paths[:, d] for d in reversed(range(DEPTH))))


def path_place(paths: np.ndarray, labels: int) -> np.ndarray:
    """Every path's place in ``path_order``."""
    place = np.empty(len(paths), np.int64)
    place[path_order(paths, labels)] = np.arange(len(paths))
    return place


def packed(paths: np.ndarray) -> np.ndarray:
    """Paths of labels below 2^21 - 1 as numbers in path order."""
    key = np.zeros(len(paths), np.int64)
    for d in range(DEPTH):
        key = (key << _BITS) | (paths[:, d].astype(np.int64) + 1)
    return key


def unpacked(key: np.ndarray) -> np.ndarray:
    """The reverse of ``packed``."""
    low = (1 << _BITS) - 1
    return np.stack([((key >> (_BITS * (DEPTH - 1 - d))) & low) - 1 for d in range(DEPTH)], axis=1).astype(np.int32)


def folded(paths: np.ndarray, weights: np.ndarray, labels: int, how: np.ufunc = np.add) -> tuple[np.ndarray, np.ndarray]:
    """Distinct paths in order, with the weights of equal ones folded by ``how``."""
    if not len(paths):
        return paths, weights
    order = path_order(paths, labels)
    paths, weights = paths[order], weights[order]
    new = np.flatnonzero(np.r_[True, (paths[1:] != paths[:-1]).any(axis=1)])
    return paths[new], how.reduceat(weights, new)


def forest(labels: pa.BinaryArray, paths: np.ndarray, weights: np.ndarray, tree: np.ndarray, trees: int) -> Iterator[Transducer]:
    """One transducer per tree, all built at once: ``tree`` tells each path's, paths are distinct and in order within it."""
    levels, state, states = [], tree, trees
    changed = np.r_[True, tree[1:] != tree[:-1]][: len(paths)]
    owner = [np.arange(trees)]  # the tree of every state
    for d in range(DEPTH):
        there = paths[:, d] >= 0
        changed = changed | np.r_[True, paths[1:, d] != paths[:-1, d]][: len(paths)]
        opens = there & changed
        arc = np.cumsum(opens) - 1
        rows = np.flatnonzero(opens)
        ends = there & (paths[:, d + 1] < 0 if d + 1 < DEPTH else True)
        weight = np.zeros(len(rows), np.int64)
        weight[arc[ends]] = weights[ends]
        levels.append([np.bincount(state[rows], minlength=states), paths[rows, d].astype(np.int64), weight, np.arange(len(rows))])
        owner.append(tree[rows])
        state, states = arc, len(rows)
    levels[-1][3] = np.zeros(len(levels[-1][3]), np.int64)
    for d in range(DEPTH - 1, 0, -1):
        levels[d], moved, kept = _merged(levels[d], owner[d])
        owner[d] = owner[d][kept]
        levels[d - 1][3] = moved[levels[d - 1][3]]
    # words of each tree, numbered from 0 in order
    wide = len(labels) + 1
    every = [np.repeat(owner[d], levels[d][0]) * wide + levels[d][1] for d in range(DEPTH)]
    used, number = np.unique(np.concatenate(every), return_inverse=True)
    first_word = np.searchsorted(used, np.arange(trees + 1) * wide)
    bounds = np.cumsum([0, *[len(x) for x in every]])
    cuts = [np.searchsorted(owner[d], np.arange(trees + 1)) for d in range(DEPTH)]
    arcs = [np.r_[0, np.cumsum(levels[d][0])] for d in range(DEPTH)]
    for t in range(trees):
        parts = []
        for d, (degree, _, weight, target) in enumerate(levels):
            a, b = cuts[d][t], cuts[d][t + 1]
            i, j = arcs[d][a], arcs[d][b]
            below = cuts[d + 1][t] if d + 1 < DEPTH else 0
            parts.append((degree[a:b], number[bounds[d] + i : bounds[d] + j] - first_word[t], weight[i:j], target[i:j] - below))
        yield Transducer(labels.take(pa.array(used[first_word[t] : first_word[t + 1]] - t * wide)), parts)


def _merged(level: list[np.ndarray], owner: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The level with one of all states of a tree that have the same arcs, each state's new number, and the states kept."""
    degree, label, weight, target = level
    first = np.cumsum(degree) - degree
    place = np.arange(len(label)) - np.repeat(first, degree)
    with np.errstate(over="ignore"):
        arcs = mixed(mixed(mixed(label + 1) + mixed(weight) * _MIX[0] + target.astype(np.uint64)) + place.astype(np.uint64))
        total = np.r_[np.uint64(0), np.cumsum(arcs)]
        print_ = mixed(total[first + degree] - total[first] + owner.astype(np.uint64) * _MIX[2]) + degree.astype(np.uint64)
    _, keep, same = np.unique(print_, return_index=True, return_inverse=True)
    chosen = keep[same]
    equal = (degree == degree[chosen]) & (owner == owner[chosen])
    check = np.flatnonzero(equal & (chosen != np.arange(len(chosen))))
    mine, other = ranges(first[check], degree[check]), ranges(first[chosen[check]], degree[check])
    differs = (label[mine] != label[other]) | (weight[mine] != weight[other]) | (target[mine] != target[other])
    if differs.any():  # two lists of arcs with one fingerprint stay apart
        equal[np.repeat(check, degree[check])[differs]] = False
    chosen = np.where(equal, chosen, np.arange(len(degree)))
    alone = chosen == np.arange(len(degree))
    kept = np.flatnonzero(alone)
    at = ranges(first[kept], degree[kept])
    return [degree[kept], label[at], weight[at], target[at]], (np.cumsum(alone) - 1)[chosen], kept


class Transducer:
    """``labels``: sorted words; ``levels``: (degree per state, label, weight, target) of every level's arcs."""

    def __init__(self, labels: pa.BinaryArray, levels: list[tuple[np.ndarray, ...]]):
        self.labels, self.levels = labels, levels

    @classmethod
    def build(cls, labels: pa.BinaryArray, paths: np.ndarray, weights: np.ndarray) -> Transducer:
        """From distinct paths in order; ``labels`` may hold words that no path uses."""
        return next(iter(forest(labels, paths, weights, np.zeros(len(paths), np.int64), 1)))

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All paths with a count, as label numbers, and their counts; shorter paths first."""
        out, counts = [], []
        rows, state = np.full((1, DEPTH), -1, np.int32), np.zeros(1, np.int64)
        for d, (degree, label, weight, target) in enumerate(self.levels):
            first = np.cumsum(degree) - degree
            arcs = ranges(first[state], degree[state])
            rows = np.repeat(rows, degree[state], axis=0)
            rows[:, d] = label[arcs]
            state, here = target[arcs], weight[arcs] > 0
            out.append(rows[here])
            counts.append(weight[arcs][here])
        return np.concatenate(out), np.concatenate(counts)

    def compose(self, labels: pa.BinaryArray, paths: np.ndarray) -> np.ndarray:
        """Counts of other paths, over words ``labels``: both walk the arcs with equal words; 0 where there is no path."""
        if not len(self.labels) or not len(labels):
            return np.zeros(len(paths), np.int64)
        number = np.r_[pc.index_in(labels, self.labels).fill_null(-2).to_numpy(zero_copy_only=False), -1].astype(np.int64)
        walk, width = number[paths], len(self.labels) + 1
        state, found, alive = np.zeros(len(paths), np.int64), np.zeros(len(paths), np.int64), np.ones(len(paths), bool)
        for d, (degree, label, weight, target) in enumerate(self.levels):
            step = alive & (walk[:, d] != -1)
            found[step] = 0
            if not len(label):
                return found
            keys = np.repeat(np.arange(len(degree)), degree) * width + label
            wanted = state[step] * width + walk[step, d]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = (keys[at] == wanted) & (walk[step, d] >= 0)
            rows = np.flatnonzero(step)
            found[rows[hit]] = weight[at[hit]]
            alive = np.zeros(len(paths), bool)
            alive[rows[hit]] = True
            state[rows[hit]] = target[at[hit]]
        return found

    def dumps(self) -> bytes:
        """Compressed bytes."""
        parts = list(sizes_and_bytes(self.labels))
        for level in self.levels:
            parts += level
        blob = bytearray()
        for part in parts:
            kind = np.min_scalar_type(int(part.max(initial=0)))
            blob += kind.char.encode() + len(part).to_bytes(8, "little") + part.astype(kind).tobytes()
        return len(blob).to_bytes(8, "little") + pa.compress(bytes(blob), codec="zstd", asbytes=True)

    @classmethod
    def loads(cls, blob: bytes) -> Transducer:
        size = int.from_bytes(blob[:8], "little")
        data, at, parts = pa.decompress(blob[8:], size, codec="zstd", asbytes=True), 0, []
        while at < size:
            kind, n = np.dtype(chr(data[at])), int.from_bytes(data[at + 1 : at + 9], "little")
            parts.append(np.frombuffer(data, kind, n, at + 9))
            at += 9 + n * kind.itemsize
        labels = words(parts[0].astype(np.int64), parts[1])
        levels = [tuple(x.astype(np.int64) for x in parts[2 + 4 * d : 6 + 4 * d]) for d in range(DEPTH)]
        return cls(labels, levels)


def sizes_and_bytes(labels: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of words and their joined bytes."""
    if not len(labels):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = labels.buffers()
    offsets = np.frombuffer(offsets, np.int32)[labels.offset : labels.offset + len(labels) + 1]
    return np.diff(offsets), np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] else np.zeros(0, np.uint8)


def words(sizes: np.ndarray, data: np.ndarray) -> pa.BinaryArray:
    """Words from their sizes and joined bytes."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data, np.uint8).tobytes())])


def numbered_words(found: pa.BinaryArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """(sorted distinct words, number of every word of ``found``)."""
    coded = found.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy(zero_copy_only=False)]


def gathered(parts: list[Transducer]) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """(labels, paths, weights, number of the part) of all paths of all parts, over one list of words."""
    labels, number = numbered_words(pa.concat_arrays([p.labels for p in parts]))
    paths, weights, of, at = [], [], [], 0
    for n, part in enumerate(parts):
        own = np.r_[number[at : at + len(part.labels)], -1].astype(np.int32)
        rows, counts = part.paths()
        paths.append(own[rows])
        weights.append(counts)
        of.append(np.full(len(rows), n))
        at += len(part.labels)
    return labels, np.concatenate(paths), np.concatenate(weights), np.concatenate(of)


def union(parts: list[Transducer], how: np.ufunc = np.add) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """(labels, distinct paths in order, weights): the paths of all parts, equal ones folded by ``how``."""
    labels, paths, weights, _ = gathered(parts)
    return labels, *folded(paths, weights, len(labels), how)
