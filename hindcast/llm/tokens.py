"""Token ids of whole texts by the tokenizers library, fast enough for a corpus.

Neither byte-pair vocabulary merges across the start of a white-space run, or from a letter to an ASCII sign after it, so the
ids of a text are the ids of its chunks one after the other.  Words recur: Arrow finds the distinct chunks of a batch, a worker
keeps the ids of those it has seen and only gives new ones to the tokenizer.  Every id comes from the library; the memory is
bounded by the number of chunks kept.
"""

from __future__ import annotations

import os
from itertools import chain, repeat

import numpy as np

from .common import give_back, slices, utf8

#: Chunks of which a worker keeps the ids; when full it forgets the rarer half.
MOST_CHUNKS = 800_000
#: Longer chunks are encoded but not kept.
LONGEST_KEPT = 64

#: Chunks of letters that go to the tokenizer as one text.
TOGETHER = 1000

#: What a byte is: of another kind, white space, an ASCII letter, an ASCII sign, part of a longer character.
_OTHER, _SPACE, _LETTER, _SIGN, _HIGH = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[k for k in range(33, 127) if not chr(k).isalnum()]] = _SIGN
_KIND[[k for k in range(128) if chr(k).isalpha()]] = _LETTER
_KIND[128:] = _HIGH
#: By 8 * kind of a byte + kind of the next one: 1 where a chunk may begin between them, 2 where the character before decides.
_BETWEEN = np.zeros(64, np.uint8)
_BETWEEN[[8 * k + _SPACE for k in (_OTHER, _LETTER, _SIGN)] + [8 * _LETTER + _SIGN]] = 1
_BETWEEN[[8 * _HIGH + _SPACE, 8 * _HIGH + _SIGN]] = 2


def _after_high(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a chunk may begin at these places, each after a character that isn't ASCII.  White space: unless that is or may
    be white space too.  A sign: after Latin letters (U+00C0 to U+024F) that stay one letter in lower case."""
    c, b, a = (body[np.maximum(at - k, 0)].astype(np.int64) for k in (1, 2, 3))
    two = b >= 0xC2
    code = (b & 31) << 6 | c & 63  # where the character has two bytes
    letter = two & (code >= 0xC0) & (code < 0x250) & (code != 0xD7) & (code != 0xF7) & (code != 0x130)
    space = ((a == 0xE1) & ((b == 0x9A) | (b == 0xA0))) | ((a == 0xE2) & ((b == 0x80) & ((c < 0x90) | (c > 0xA7)) | (b == 0x81)))
    space |= ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xEF) & (b == 0xBB) & (c == 0xBF))
    return np.where(_KIND[body[at]] == _SIGN, letter, np.where(two, code >= 0xC0, ~space))


def chunk_starts(body: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where the chunks of all texts begin.  Those in ``whole`` (a flag for each text) are one chunk."""
    kind = _KIND[body]
    between = _BETWEEN[(kind[:-1] << 3) | kind[1:]]
    unsure = np.flatnonzero(between == 2) + 1
    begins = np.zeros(len(body) + 1, bool)
    begins[1:-1] = between == 1
    begins[unsure] = _after_high(body, unsure)
    for k in np.flatnonzero(whole):
        begins[offsets[k] : offsets[k + 1]] = False
    begins[offsets] = True
    return np.flatnonzero(begins[:-1])


class Encoder:
    """``mode`` "spaced": byte-level BPE, ids carry the space before a word.  "words": white space separates only, ids the end of a word."""

    _made: dict[tuple[str, str, int], Encoder] = {}

    def __init__(self, path: str, mode: str, most: int = MOST_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Texts with the string of an added token (<|endoftext|>), which is one id there, go whole.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most
        # Chunks of a space and letters can go to the tokenizer together: each is one part, whose last id carries the mark of a
        # word's end, or whose first id that of the space before it.
        size = self.tokenizer.get_vocab_size()
        token = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.last = {"spaced": False, "words": True}[mode]
        self.edge = np.array([t.endswith("</w>") if self.last else t.startswith("\u0120") for t in token])
        self.clear()

    @classmethod
    def of(cls, path: str, mode: str, most: int = MOST_CHUNKS) -> Encoder:
        if (path, mode, most) not in cls._made:
            cls._made[path, mode, most] = cls(path, mode, most)
        return cls._made[path, mode, most]

    @classmethod
    def forget(cls):
        """Frees the memory of a worker that goes on with other work."""
        if cls._made:
            cls._made.clear()
            give_back()

    def clear(self):
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 16, np.int64)
        self.width = np.zeros(1 << 16, np.int64)
        self.seen = np.zeros(1 << 16, np.int32)
        self.used = 0

    def trim(self):
        """Keeps the chunks seen most often, at most half of what there is room for; what they count is halved, so that
        chunks of long ago make way for those of now."""
        seen = self.seen[: len(self.known)]
        least = 2
        while np.count_nonzero(seen >= least) > self.most // 2:
            least += 1
        kept = [c for c, k in self.known.items() if seen[k] >= least]
        number = np.fromiter((self.known[c] for c in kept), np.int64, len(kept))
        start, width, flat = self.start[number], self.width[number], self.flat
        self.clear()
        room = max(1 << 16, 1 << len(kept).bit_length())
        self.start, self.width, self.seen = np.zeros(room, np.int64), np.zeros(room, np.int64), np.zeros(room, np.int32)
        self.flat = flat[slices(start, width)]
        self.used = len(self.flat)
        self.start[: len(kept)], self.width[: len(kept)] = np.cumsum(width) - width, width
        self.seen[: len(kept)] = seen[number] // 2
        self.known = dict(zip(kept, range(len(kept))))

    def _learn(self, chunks: list[str]):
        plain = [c for c in chunks if c[0] == " " and c[1:].isalpha()]
        rest = set(chunks).difference(plain)
        for lo in range(0, len(plain), TOGETHER):
            some = plain[lo : lo + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.int32)
            edge = np.flatnonzero(self.edge[ids])  # the last, or first, id of each part that the library makes of the text
            if len(edge) == len(some):  # every chunk has one part at least, so each has one
                ends = edge + 1 if self.last else np.append(edge[1:], len(ids))
                self._keep(some, ids, np.diff(ends, prepend=0))
            else:
                rest.update(some)
        if rest:
            alone = list(rest)
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
            width = np.fromiter(map(len, encoded), np.int64, len(encoded))
            self._keep(alone, np.fromiter(chain.from_iterable(encoded), np.int32, int(width.sum())), width)

    def _keep(self, chunks: list[str], ids: np.ndarray, width: np.ndarray):
        n, total = len(self.known), len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), 1 << 16), np.int32)])
        while n + len(chunks) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.width = np.concatenate([self.width, np.zeros_like(self.width)])
            self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
        self.start[n : n + len(chunks)] = self.used + np.cumsum(width) - width
        self.width[n : n + len(chunks)] = width
        self.flat[self.used : self.used + total] = ids
        self.used += total
        self.known.update(zip(chunks, range(n, n + len(chunks))))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (a list or an Arrow array), one after the other, and the number of ids of each text.  None is an
        empty text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.known) > self.most:
            self.trim()
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
        body, offsets = utf8(texts)
        if not len(body):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False)
        begin = chunk_starts(body, offsets, whole)
        ends = np.append(begin, len(body))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(body)]).dictionary_encode()
        index, names = chunks.indices.to_numpy(), chunks.dictionary.cast(pa.large_string()).to_pylist()
        number = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            new = [names[k] for k in fresh]
            self._learn([c for c in new if len(c) <= LONGEST_KEPT])
            number[fresh] = np.fromiter(map(self.known.get, new, repeat(-1)), np.int64, len(new))
        kept = number >= 0
        self.seen[number[kept]] += np.bincount(index, minlength=len(names))[kept].astype(np.int32)
        start, width, flat = self.start[number], self.width[number], self.flat
        if not kept.all():  # encoded by themselves
            lone = np.flatnonzero(~kept)
            alone = [self._whole(names[k]) for k in lone]
            width[lone] = np.array([len(x) for x in alone], np.int64)
            start[lone] = self.used + np.cumsum(width[lone]) - width[lone]
            flat = np.concatenate([self.flat[: self.used], *alone])
        width = width[index]
        total = np.concatenate([[0], np.cumsum(width)])
        return flat[slices(start[index], width)], np.diff(total[np.searchsorted(begin, offsets)])
