"""Token ids of whole texts by the `tokenizers` library, fast on repeated words.

A text is cut before every space that follows a character other than white space: no pre-token of
the vocabularies used here reaches over such a place, so the parts' ids in order are the text's ids
(texts with white space before a space, or with the string of a special token, are encoded whole). Parts of plain letters and marks are cut
further, between letters and what is no letter, except after an apostrophe or several white-space
characters, where pre-tokens depend on what follows. A worker keeps ids of parts in dictionaries of
bounded size, over all its tasks; beyond that they are encoded anew. Either way they are the
library's ids. Parts are looked up many at a time, in arrays: by a hash, and then by all their bytes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Sequence
from functools import lru_cache

import numpy as np

from . import common

#: Parts, and parts of parts, whose ids a worker keeps; the longest part kept; parts of one call of the library.
PARTS, SEGMENTS, LONGEST, CALL = 800_000, 500_000, 64, 20_000
#: Bytes of text whose parts are looked up together.
AT_ONCE = 1 << 17
_WHITE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of a number's first n bytes

_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD = re.compile(rf" ?[{_L}]+")
#: A space, a word and marks; any part of plain characters; its segments; a letter whose pre-token depends on what is before.
_SIMPLE = re.compile(rf"( [{_L}]+)([!-@\[-`{{-~\n]*)")
_PLAIN = re.compile(rf" ?[\x21-\x7e\n{_L}]+")
_SEGMENT = re.compile(rf" ?[{_L}]+|[^{_L}]+")
_OPEN = re.compile(rf"(?:'|\s\s)[{_L}]")
#: Marks; white space beyond ASCII before a space.
_MARKS = "".join(map(chr, [*range(0x21, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F), 10]))
_SPACED_FAR = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")


def vocabulary(name: str) -> str:
    """The place of one of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str, parts: int | None = None, segments: int | None = None) -> Encoder:
    """The worker's encoder for a tokenizer's file: its dictionaries serve all tasks of the worker until another operator's
    task lets go of them (common.let_go)."""
    return Encoder(path, parts, segments)


def _spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places at, at + 1, ..., at + n - 1 of all pairs in order."""
    ends = np.cumsum(n)
    return np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


class Words:
    """Stretches of a text: where each begins, its size, its bytes as numbers of eight (columns; short ones end in zeros), and
    a hash of these. Longer ones than LONGEST are hashed by their first bytes and never known."""

    def __init__(self, data: bytes, at: np.ndarray, size: np.ndarray) -> None:
        # a number from every byte on
        every = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
        self.at, self.size, self.hash, self.more = at, size, size.astype(np.uint64), []
        for k in range(0, LONGEST, 8):
            own = np.flatnonzero(size > k) if k else np.arange(len(at))
            if not len(own):
                break
            x = every[at[own] + k] & _LOW[np.minimum(size[own] - k, 8)]
            self.hash[own] = common.mixed(self.hash[own] ^ x)
            self.more.append((own, x))


class Known:
    """Ids of up to `most` words in arrays: an open hash table of the words' numbers."""

    def __init__(self, most: int) -> None:
        self.most, self.n = most, 0
        self.slots = np.full(1 << max(1, (2 * most).bit_length()), -1, np.int32)
        kinds = {"hash": np.uint64, "size": np.int32, "tail": np.int64, "at": np.int64, "count": np.int32}
        self.columns = {c: np.zeros(1024, kind) for c, kind in kinds.items()}
        self.numbers, self.n_numbers = np.zeros(1024, np.uint64), 0
        self.ids, self.n_ids = np.zeros(1024, np.uint32), 0

    @staticmethod
    def _grown(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, len(x) * 5 // 4) - len(x), x.dtype)])

    def find(self, words: Words) -> np.ndarray:
        """The entry of each word, or -1."""
        out, mask = np.full(len(words.at), -1, np.int64), len(self.slots) - 1
        own = np.arange(len(out))
        slot = (words.hash & np.uint64(mask)).astype(np.int64)
        while len(own):
            entry = self.slots[slot]
            held = entry >= 0
            same = held & (self.columns["hash"][entry] == words.hash[own])
            out[own[same]] = entry[same]
            go = held & ~same
            own, slot = own[go], slot[go] + 1 & mask
        # equal hashes are no proof
        out[(out >= 0) & (self.columns["size"][out] != words.size)] = -1
        for k, (own, x) in enumerate(words.more):
            entry = out[own]
            differ = (entry >= 0) & (self.numbers[np.where(entry >= 0, self.columns["tail"][entry] + k, 0)] != x)
            out[own[differ]] = -1
        return out

    def add(self, words: Words, which: np.ndarray, ids: list[bytes]) -> None:
        """Keeps the ids of words which[k], all different and none of them known, as far as there is room."""
        fits = words.size[which] <= LONGEST
        hashes = words.hash[which]
        first = np.zeros(len(which), bool)
        first[np.unique(hashes, return_index=True)[1]] = True
        take = np.flatnonzero(fits & first)[: self.most - self.n]
        if not len(take):
            return
        which, ids, hashes = which[take], [ids[k] for k in take.tolist()], hashes[take]
        size, count = words.size[which], np.array([len(i) // 4 for i in ids])
        n_tail = np.maximum(1, -(-size // 8))
        tail = self.n_numbers + np.cumsum(n_tail) - n_tail
        self.numbers = self._grown(self.numbers, self.n_numbers + int(n_tail.sum()))
        for k, (own, x) in enumerate(words.more):
            mine = np.flatnonzero(n_tail > k)
            self.numbers[tail[mine] + k] = x[np.searchsorted(own, which[mine])]
        self.n_numbers += int(n_tail.sum())
        flat = np.frombuffer(b"".join(ids), "<u4")
        self.ids = self._grown(self.ids, self.n_ids + len(flat))
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        entry = np.arange(self.n, self.n + len(which))
        for c, x in (("hash", hashes), ("size", size), ("tail", tail), ("at", self.n_ids + np.cumsum(count) - count), ("count", count)):
            self.columns[c] = self._grown(self.columns[c], self.n + len(which))
            self.columns[c][entry] = x
        self.n, self.n_ids = self.n + len(which), self.n_ids + len(flat)
        mask = len(self.slots) - 1
        slot = (hashes & np.uint64(mask)).astype(np.int64)
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]
            rest = self.slots[slot] != entry  # of several, one has the slot
            entry, slot = entry[rest], slot[rest] + 1 & mask


class Encoder:
    """Texts as UTF-8 to ids, little-endian unsigned 32-bit."""

    def __init__(self, path: str, parts: int | None = None, segments: int | None = None) -> None:
        self.most_parts, self.most_segments = PARTS if parts is None else parts, SEGMENTS if segments is None else segments
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]  # texts that hold one are encoded whole
        self.known = Known(self.most_parts)  # parts, without the space before them
        self.segments: dict[str, bytes] = {}
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None  # the id that parts words in one call
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a word, where white space has no id
        for token, k in self.tokenizer.get_vocab().items():
            self.last[k] = token.endswith("</w>")

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, each with a space before it or none, by one call."""
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, "<u4")
        if self.line is not None:
            cut = np.flatnonzero(ids == self.line)
            starts, ends = np.append(0, cut + 1), np.append(cut, len(ids))
        else:
            ends = np.flatnonzero(self.last[ids]) + 1
            starts = np.append(0, ends[:-1])
        if len(starts) != len(words):
            return self._ids(words)
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def _fill(self, missing: list[str], cache: dict, most: int, extra: dict, call) -> None:
        for k in range(0, len(missing), CALL):
            part = missing[k : k + CALL]
            for x, ids in zip(part, call(part), strict=True):
                (cache if len(x) <= LONGEST and len(cache) < most else extra)[x] = ids

    def _learn(self, missing: Iterable[str], whole: set[str]) -> dict[str, bytes]:
        """The ids of parts; whole ones, which may hold a special token, are not cut."""
        get, out, cut, whole = self.segments.get, {}, [], list(whole)
        for x in missing:
            # most parts are a known word and known marks, or just the word
            word = x.rstrip(_MARKS)
            if len(word) > 1 and (first := get(word)) is not None and (second := get(x[len(word) :]) if len(word) < len(x) else b"") is not None:
                out[x] = first + second
            elif m := _SIMPLE.fullmatch(x):
                cut.append((x, m.groups() if m[2] else (m[1],)))
            elif _PLAIN.fullmatch(x) and not _OPEN.search(x):
                cut.append((x, _SEGMENT.findall(x)))
            else:
                whole.append(x)
        segments = {s for _, parts in cut for s in parts if s not in self.segments}
        words = [s for s in segments if _WORD.fullmatch(s)]
        more: dict[str, bytes] = {}
        self._fill(words, self.segments, self.most_segments, more, self._words)
        self._fill(list(segments.difference(words)), self.segments, self.most_segments, more, self._ids)
        self._fill(whole, out, 0, out, self._ids)
        for x, parts in cut:
            out[x] = b"".join([more[s] if (i := get(s)) is None else i for s in parts])
        return out

    def encode(self, payloads: Sequence[bytes | None]) -> list[bytes]:
        out, at, size = [], 0, 0
        for k, p in enumerate(payloads, 1):  # as much at a time as a processor's cache holds
            size += len(p) if p else 0
            if size > AT_ONCE or k == len(payloads):
                out += self._encode(payloads[at:k])
                at, size = k, 0
        return out

    def _encode(self, payloads: Sequence[bytes | None]) -> list[bytes]:
        texts = [p or b"" for p in payloads]
        data = b" ".join(texts)
        try:
            ascii_ = data.isascii() or not data.decode()
        except UnicodeDecodeError:
            return self._encode([p.decode("utf-8", "replace").encode() for p in texts])
        sizes = np.array([len(p) for p in texts])
        starts = np.cumsum(sizes + 1) - sizes - 1
        read = np.frombuffer(data, np.uint8)
        space = np.flatnonzero(read == 32)
        # texts with white space before a space are taken whole: a space at a text's start comes after the one that joins
        joint = np.zeros(len(data) + 1, bool)
        joint[starts[1:] - 1] = True
        far = space[(_WHITE[read[space - 1]] & (space > 0) | (space == 0)) & ~joint[space]]
        whole = np.zeros(len(texts), bool)
        whole[np.searchsorted(starts, far, "right") - 1] = True
        special = set()
        for k, p in enumerate(texts) if not ascii_ or any(x.encode() in data for x in self.special) else ():
            if any(x.encode() in p for x in self.special):
                whole[k] = True
                special.add(p.decode())
            elif not p.isascii() and _SPACED_FAR.search(p.decode()):
                whole[k] = True
        at, end = np.append(0, space + 1), np.append(space, len(data))
        head = np.searchsorted(at, starts)  # the part with which a text begins
        n_parts = np.diff(np.append(head, len(at)))
        n_rest = np.where(whole, 0, n_parts - 1)
        rest = _spread(head + 1, n_rest)
        firsts = [p.decode() if w else data[a:b].decode() for p, w, a, b in zip(texts, whole.tolist(), at[head].tolist(), end[head].tolist(), strict=True)]
        begin = self._learn({x for x in firsts if x not in special}, special)
        begin[""] = b""

        words = Words(data, at[rest], end[rest] - at[rest])
        entry = self.known.find(words)
        missing = np.flatnonzero(entry < 0)
        names = [data[a : a + n] for a, n in zip(words.at[missing].tolist(), words.size[missing].tolist(), strict=True)]
        place = dict(zip(names, missing.tolist(), strict=True))
        parts = [f" {x.decode()}" for x in place]
        learned = list(map(self._learn(parts, set()).__getitem__, parts))
        n_ids, from_ = self.known.columns["count"][entry], self.known.columns["at"][entry]
        number = dict(zip(place, range(len(place)), strict=True))
        which = np.array([number[x] for x in names], np.int64)
        count = np.array([len(x) // 4 for x in learned], np.int64)
        n_ids[missing] = count[which]
        ids = np.empty(int(n_ids.sum()), "<u4")
        to = np.cumsum(n_ids) - n_ids
        have = np.flatnonzero(entry >= 0)
        is_new = np.repeat(entry < 0, n_ids)
        ids[~is_new] = self.known.ids[_spread(from_[have], n_ids[have])]
        ids[is_new] = np.frombuffer(b"".join(learned), "<u4")[_spread((np.cumsum(count) - count)[which], count[which])]
        self.known.add(words, np.fromiter(place.values(), np.int64, len(place)), learned)
        upto = np.append(to, len(ids))[np.append(0, np.cumsum(n_rest))].tolist()
        raw = ids.tobytes()
        return [begin[x] + raw[4 * a : 4 * b] for x, a, b in zip(firsts, upto, upto[1:], strict=False)]
