"""Byte-pair merges of many pre-tokens at once, and the encoding of plain texts with them, in numpy.

A round finds the pair of lowest rank of each pre-token and merges it wherever it stands there, from the
left; a pre-token is done when no pair of its tokens has a rank. That is what BPE does one merge after another, as
long as each merge joins bytes or tokens of earlier merges: then a new pair never ranks under the one just merged.
"""

from __future__ import annotations

import json

import numpy as np

from cavitas.llm.common import word_hashes

NONE = np.int32(1 << 30)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = ~np.uint64(0)


class Table:
    """Numbers under 64-bit keys, by open addressing; at most half of the slots should be taken."""

    def __init__(self, size: int):
        bits = (2 * size).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, _EMPTY), np.full(1 << bits, NONE)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are not there, each once."""
        slots, todo = keys * _FACTOR >> self.shift, np.arange(len(keys))
        while len(todo):
            at, first = np.unique(slots[todo], return_index=True)
            free = self.keys[at] == _EMPTY
            self.keys[at[free]], self.values[at[free]] = keys[todo[first[free]]], values[todo[first[free]]]
            todo = np.delete(todo, first[free])
            slots[todo] = slots[todo] + np.uint64(1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, ``NONE`` if it has none."""
        slots = keys * _FACTOR >> self.shift
        found = self.keys[slots]
        values = np.where(found == keys, self.values[slots], NONE)
        todo = np.flatnonzero((found != keys) & (found != _EMPTY))
        while len(todo):
            slots[todo] = slots[todo] + np.uint64(1) & self.mask
            found, wanted = self.keys[slots[todo]], keys[todo]
            hit = found == wanted
            values[todo[hit]] = self.values[slots[todo[hit]]]
            todo = todo[~hit & (found != _EMPTY)]
        return values


class Merges:
    def __init__(self, byte_ids: np.ndarray, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        """Ids of the 256 bytes; of each merge, in order of rank, its two tokens and what they give."""
        self.byte_ids, self.merged = byte_ids.astype(np.uint32), merged.astype(np.uint32)
        self.table = Table(2 * len(merged))
        self.table.add(self._key(left, right), np.arange(len(merged), dtype=np.int32))
        self.byte_ranks = self.rank(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).reshape(256, 256)

    @classmethod
    def of(cls, tokenizer, alphabet: dict[int, str]) -> Merges | None:
        """Those of a tokenizer; None if its model is anything but plain byte-level BPE, for which the rounds hold."""
        whole = json.loads(tokenizer.to_str())
        model, split = whole["model"], whole["pre_tokenizer"] or {}
        plain = not whole["normalizer"] and split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split["use_regex"] and model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or not set(alphabet.values()) <= set(model["vocab"]):
            return None
        vocab, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = set(alphabet.values())
        for a, b in pairs:
            if a not in made or b not in made or a + b in made:
                return None
            made.add(a + b)
        ids = [np.array([vocab[x] for x in y], np.uint32) for y in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs])]
        return cls(np.array([vocab[alphabet[b]] for b in range(256)]), *ids)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(32) | right

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` if it is none."""
        return self.table.get(self._key(left, right))

    def encode(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pre-tokens of ``sizes`` bytes, one or more, one after another in ``data``: their numbers in an order of its own, how many ids each has, and the ids."""
        ids = self.byte_ids[data]
        names = np.arange(len(sizes))
        ranks = np.full(len(ids), NONE)
        ranks[:-1] = self.byte_ranks[data[:-1], data[1:]]
        ranks[np.cumsum(sizes) - 1] = NONE  # a pre-token's last token has no pair
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(names):
            least = np.minimum.reduceat(ranks, np.cumsum(sizes) - sizes)
            over = least == NONE
            if over.any():
                gone = np.repeat(over, sizes)
                done.append((names[over], sizes[over], ids[gone]))
                ids, ranks, names, sizes, least = ids[~gone], ranks[~gone], names[~over], sizes[~over], least[~over]
                if not len(names):
                    break
            hits = np.flatnonzero(ranks == np.repeat(least, sizes))
            if len(hits) > 1:  # of a run of pairs that overlap, every second one from the left
                first = np.concatenate([[True], hits[1:] != hits[:-1] + 1])
                place = np.arange(len(hits))
                hits = hits[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
            ids[hits] = self.merged[ranks[hits]]
            kept = np.ones(len(ids), bool)
            kept[hits + 1] = False
            sizes = np.add.reduceat(kept, np.cumsum(sizes) - sizes, dtype=np.int64)
            ids, ranks = ids[kept], ranks[kept]
            new = hits - np.arange(len(hits))  # where the merged tokens are now
            ranks[new] = NONE
            last = np.zeros(len(ids), bool)
            last[np.cumsum(sizes) - 1] = True
            pairs = np.concatenate([new, new[new > 0] - 1])
            pairs = pairs[~last[pairs]]
            ranks[pairs] = self.rank(ids[pairs], ids[pairs + 1])
        return tuple(map(np.concatenate, zip(*done, strict=True))) if done else (names, sizes, ids)


#: Kinds of bytes: white space, the runs of one kind that pre-tokens are, and others; bytes from 6 on are looked at with the next.
_SPACE, _NEWLINE, _LETTER, _DIGIT, _SIGN, _OTHER, _LEAD, _TRAIL = range(8)
_KIND = np.full(256, _OTHER, np.uint8)
for _bytes, _kind in ((b" ", _SPACE), (b"\n", _NEWLINE), (bytes(range(48, 58)), _DIGIT), (bytes([*range(65, 91), *range(97, 123)]), _LETTER), (bytes(range(0xC3, 0xCA)), _LEAD), (bytes(range(0x80, 0xC0)), _TRAIL)):
    _KIND[list(_bytes)] = _kind
_KIND[[b for b in range(33, 127) if _KIND[b] == _OTHER and chr(b) != "'"]] = _SIGN


def _kinds(data: np.ndarray) -> np.ndarray:
    """Kinds of the bytes of UTF-8 text; Latin letters of two bytes (U+00C0 to U+024F without the two signs) are letters."""
    kinds = _KIND[data]
    lead = np.flatnonzero(kinds == _LEAD)
    if len(lead):
        one, two = data[lead], data[lead + 1]
        lead = lead[np.where(one == 0xC3, (two != 0x97) & (two != 0xB7), (one < 0xC9) | (two < 0x90))]
        kinds[lead] = kinds[lead + 1] = _LETTER
    return np.minimum(kinds, _OTHER)


class Plain:
    """Encodes texts of Latin letters, digits and signs but the apostrophe, with single spaces and line ends between, whose pre-tokens bytes tell.

    The ids of pre-tokens seen before are kept, under 64-bit hashes of their bytes, until there are over ``keep``.
    """

    def __init__(self, merges: Merges, keep: int, longest: int):
        self.merges, self.keep, self.longest = merges, keep, longest
        self._forget()

    def _forget(self, least: int = 0) -> None:
        self.table = Table(max(self.keep, least))
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of pre-tokens among those kept, which the new ones are added to."""
        hashes = word_hashes(data, starts, ends)
        numbers = self.table.get(hashes)
        new = np.flatnonzero(numbers == NONE)
        if len(new):
            if len(self.sizes) + len(new) > self.keep:
                self._forget(len(hashes))
                numbers[:], new = NONE, np.arange(len(hashes))
            own, first = np.unique(hashes[new], return_index=True)
            at, sizes = starts[new[first]], (ends - starts)[new[first]]
            names, counts, ids = self.merges.encode(data[spans(at, sizes)], sizes)
            self.table.add(own[names], np.arange(len(names), dtype=np.int32) + np.int32(len(self.sizes)))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.sizes, self.ids = np.concatenate([self.sizes, counts]), np.concatenate([self.ids, ids])
            numbers[new] = self.table.get(hashes[new])
        return numbers

    def encode(self, texts: list[bytes]) -> list[bytes | None]:
        """Ids as little-endian unsigned 32-bit integers; None for a text that is not plain."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not len(data):
            return [b""] * len(texts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        kinds = _kinds(data)
        blank, first = kinds <= _NEWLINE, np.zeros(len(data) + 1, bool)
        first[0] = first[ends] = True
        start = first[:-1].copy()
        start[1:] |= blank[1:] | ((kinds[1:] != kinds[:-1]) & (kinds[:-1] != _SPACE))
        starts = np.flatnonzero(start)
        stops = np.append(starts[1:], len(data))
        other = kinds == _OTHER
        other[:-1] |= blank[:-1] & blank[1:]
        other |= blank & first[1:]  # at a text's end
        other[starts[stops - starts > self.longest]] = True
        if other.any():
            odd = set(np.searchsorted(ends, np.flatnonzero(other), side="right").tolist())
            rest = iter(self.encode([t for k, t in enumerate(texts) if k not in odd]))
            return [None if k in odd else next(rest) for k in range(len(texts))]
        numbers = self._numbers(data, starts, stops)
        sizes = self.sizes[numbers]
        ids = self.ids[spans(self.starts[numbers], sizes)].astype("<u4").tobytes()
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, ends)] * 4
        return [ids[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)]


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of each span, one span after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
