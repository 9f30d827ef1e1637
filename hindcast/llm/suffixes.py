"""Deep-shallow sorting of fixed-length strings that start at given places of a text, and content-chosen anchors."""

from __future__ import annotations

import os

import numpy as np

from .common import mix

#: Words of 8 bytes that the multikey quicksort looks at before the blind tries take over.
SHALLOW = 3
#: Window starts looked at together while anchors are chosen; places inside take 22 bits.
BLOCK = 1 << 21
_PLACE = 22


def words_at(body: np.ndarray, starts: np.ndarray, offset: int) -> np.ndarray:
    """The 8 bytes from start + offset as one number each, in the order of the bytes."""
    view = np.ndarray((len(body) - 7,), dtype=">u8", buffer=body, strides=(1,))
    return view[starts + offset].astype(np.uint64)


class BlindTrie:
    """Orders distinct strings of one length.  A node is [depth, {byte: child}]; a leaf is the number of its string.

    The descent looks only at the bytes where the trie branches; one comparison with the leaf it ends in then tells
    where the string belongs.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int = 0
        for k in range(1, len(strings)):
            self._insert(k)

    def _insert(self, k: int) -> None:
        s, node = self.strings[k], self.root
        while not isinstance(node, int):
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        common = len(os.path.commonprefix([s, self.strings[node]]))
        above, node = None, self.root
        while not isinstance(node, int) and node[0] < common:
            above, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == common:
            node[1][s[common]] = k
            return
        some = node
        while not isinstance(some, int):
            some = next(iter(some[1].values()))
        new = [common, {self.strings[some][common]: node, s[common]: k}]
        if above is None:
            self.root = new
        else:
            above[1][s[above[0]]] = new

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow(body: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings body[start : start + length], and the number of the class of equal strings of each, in
    that order.  ``length`` is at least 8.

    Multikey quicksort on words of 8 bytes up to the shallow depth: each pass only touches strings that are still in a
    group.  In the groups that are left, equal strings are one leaf; two leaves are compared at their first differing
    word, more go into a blind trie.
    """
    offsets = [*range(0, length - 7, 8)]
    if offsets[-1] + 8 < length:
        offsets.append(length - 8)  # the bytes before are equal where this one is looked at
    n = len(starts)
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # of the string at each place of the order
    for offset in offsets[:SHALLOW]:
        size = np.bincount(group)
        at = np.flatnonzero(size[group] > 1)
        if not len(at):
            break
        word = words_at(body, starts[order[at]], offset)
        by = np.lexsort((word, group[at]))
        order[at] = order[at[by]]
        word = word[by]
        new = np.zeros(n, bool)
        new[1:] = group[1:] != group[:-1]
        new[at[1:]] |= (word[1:] != word[:-1]) & (group[at[1:]] == group[at[:-1]])
        group = np.cumsum(new)
    if len(offsets) > SHALLOW:
        size = np.bincount(group, minlength=1)
        at = np.flatnonzero(size[group] > 1)
        if len(at):
            deep = [words_at(body, starts[order[at]], o) for o in offsets[SHALLOW:]]
            print_ = mix(deep[0])
            for w in deep[1:]:
                print_ = mix(print_ * np.uint64(0xD6E8FEB86659FD93) + w)
            by = np.lexsort((print_, group[at]))
            own, print_ = group[at][by], print_[by]
            leaf = np.ones(len(at), bool)
            leaf[1:] = (own[1:] != own[:-1]) | (print_[1:] != print_[:-1])
            first = np.flatnonzero(leaf)  # of each leaf
            which = by[first]
            trie = own[first]
            begin = np.flatnonzero(np.concatenate([[True], trie[1:] != trie[:-1]]))
            leaves = np.diff(np.append(begin, len(trie)))
            rank = np.zeros(len(first), np.int64)  # of the leaf in its trie
            two = begin[leaves == 2]
            undecided, later = np.ones(len(two), bool), np.zeros(len(two), bool)
            for w in deep:
                a, b = w[which[two]], w[which[two + 1]]
                later |= undecided & (a > b)
                undecided &= a == b
            rank[two], rank[two + 1] = later, ~later
            for b, k in zip(begin[leaves > 2], leaves[leaves > 2]):
                strings = [body[s : s + length].tobytes() for s in starts[order[at[which[b : b + k]]]]]
                rank[b + np.array(BlindTrie(strings).order())] = np.arange(k)
            number = np.cumsum(leaf) - 1
            place = np.lexsort((rank[number], own))
            order[at] = order[at[by[place]]]
            own, number = own[place], number[place]
            new = np.zeros(n, bool)
            new[1:] = group[1:] != group[:-1]
            new[at[1:]] |= (number[1:] != number[:-1]) & (own[1:] == own[:-1])
            group = np.cumsum(new)
    return order, group


def anchors(body: np.ndarray, offsets: np.ndarray, length: int, gram: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of window starts that share an anchor: hash of the anchor, first and last window start, document.

    The anchor of a window of ``length`` bytes is the place of the smallest hash among its grams of ``gram`` (a multiple
    of 8) bytes.  Equal windows have equal anchors at the same place, wherever they stand.
    """
    out = []
    if len(body) >= length:
        ends = np.repeat(offsets[1:], np.diff(offsets))
        for lo in range(0, len(body) - length + 1, BLOCK):
            hi = min(lo + BLOCK, len(body) - length + 1)
            part = body[lo : hi + length - 1]
            view = np.ndarray((len(part) - 7,), dtype="<u8", buffer=np.ascontiguousarray(part), strides=(1,))
            n = len(part) - gram + 1
            h = np.zeros(n, np.uint64)
            for i, factor in zip(range(0, gram, 8), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)):
                h ^= view[i : i + n] * np.uint64(factor)
                h ^= h >> np.uint64(29)
            h = mix(h)
            key = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(n, dtype=np.uint64)
            width, span = length - gram + 1, 1
            while span * 2 <= width:
                key = np.minimum(key[:-span], key[span:])
                span *= 2
            if span < width:
                key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
            place = (key & np.uint64((1 << _PLACE) - 1)).astype(np.int64)[: hi - lo]
            p = np.flatnonzero(np.arange(lo, hi) + length <= ends[lo:hi])
            if not len(p):
                continue
            a = place[p]
            new = np.ones(len(p), bool)
            new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(p)) - 1
            out.append((h[a[first]], p[first] + lo, p[last] + lo))
    if not out:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    h, first, last = (np.concatenate(x) for x in zip(*out))
    return h, first, last, np.searchsorted(offsets, first, side="right") - 1
