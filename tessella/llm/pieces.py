"""Words to pieces of a fixed vocabulary, many words at once.

Words of equal length advance together: at each end position the hashes of all substrings that end there probe the
sorted keys of the pieces, each hit gets a value, and a vectorised maximum stores the length of the best last piece.

- A unigram vocabulary's value is the score of the best path: the Viterbi search.
- In a vocabulary of ranked merges (BPE) a piece may follow another only where encoding the two gives just the two.
  A sequence all of whose neighbours fit is the encoding, and the encoding of a prefix never changes as the word
  grows by whole pieces, so exactly one last piece fits at each position. The value is 0 there and minus infinity
  elsewhere, and the same search gives exactly the ids that merging gives.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

BASE, SPREAD, SIEVE_BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 20
NEVER = np.int32(2**31 - 1)
#: Substrings that are looked up at once.
ELEMENTS = 1 << 21
#: Longer words are cut where no piece reaches across.
LONG = 64
#: Longer parts of merged vocabularies go by themselves, as they have few or no others of their length to advance with.
LONE = 1024


def _sieve(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << SIEVE_BITS, bool)
    out[_slot(keys)] = True
    return out


def _slot(keys: np.ndarray) -> np.ndarray:
    return keys * SPREAD >> np.uint64(64 - SIEVE_BITS)


def _places(keys: np.ndarray) -> np.ndarray:
    """For each slot the place of one of its keys."""
    out = np.zeros(1 << SIEVE_BITS, np.int32)
    out[_slot(keys)] = np.arange(len(keys))
    return out


def _found(keys: np.ndarray, places: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """Where each sought key is in sorted keys, or of another key where it is none: keys that share a slot are searched for."""
    at = places[_slot(sought)]
    other = np.flatnonzero(keys[at] != sought)
    at[other] = np.minimum(np.searchsorted(keys, sought[other]), len(keys) - 1)
    return at


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """(words, length) codes to the hashes of all prefixes, the empty one first. Arithmetic is modulo 2**64."""
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * SPREAD
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * BASE + mixed[:, j]
    return out


@dataclass
class Pieces:
    """symbols: each usable piece as codes, by id. merges: for BPE (left, right, merged, rank), sorted by rank of the
    merged piece; scores: for unigram, by id."""

    symbols: dict[int, tuple[int, ...]]
    size: int
    merges: tuple[np.ndarray, ...] | None = None
    scores: np.ndarray | None = None
    keys: np.ndarray = field(init=False)

    def __post_init__(self):
        self.longest = max(map(len, self.symbols.values()))
        by_length: dict[int, list[int]] = {}
        for i, s in self.symbols.items():
            by_length.setdefault(len(s), []).append(i)
        ids, keys = [], []
        for own in by_length.values():
            ids.append(np.array(own))
            keys.append(prefix_hashes(np.array([self.symbols[i] for i in own]))[:, -1])
        inner = [np.array([self.symbols[i] for i in own], np.uint64) for n, own in by_length.items() if n > 1]
        self.inner = np.unique(np.concatenate([np.zeros(0, np.uint64), *((x[:, :-1] << np.uint64(32) | x[:, 1:]).ravel() for x in inner)]))
        ids, keys = np.concatenate(ids), np.concatenate(keys)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order].astype(np.int32)
        assert (self.keys[1:] != self.keys[:-1]).all(), "two pieces have one hash"
        self.sieve = _sieve(self.keys)
        self.powers = np.ones(self.longest + 1, np.uint64)
        self.powers[1:] = np.multiply.accumulate(np.full(self.longest, BASE))
        if self.merges is not None:
            left, right, merged, rank = (np.asarray(x, np.int64) for x in self.merges)
            pair = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
            order = np.argsort(pair)
            self.pair_keys, self.pair_rank, self.pair_sieve = pair[order], rank[order].astype(np.int32), _sieve(pair)
            self.pair_places = _places(self.pair_keys)
            pairs = {(a, b): (r, m) for a, b, m, r in zip(left.tolist(), right.tolist(), merged.tolist(), rank.tolist(), strict=True)}
            code = {s[0]: i for i, s in self.symbols.items() if len(s) == 1}
            self.rank, self.left, self.right = (np.full(self.size, -1, np.int32) for _ in range(3))
            usable = np.zeros(self.size, bool)
            for i, s in self.symbols.items():
                ids_, last = merge([code[c] for c in s], pairs) if all(c in code for c in s) else ([], None)
                if len(ids_) == 1:
                    usable[i] = True
                    if last:
                        self.left[i], self.right[i], self.rank[i] = last
            self.strings = {"".join(map(chr, s)): i for i, s in self.symbols.items() if usable[i]}
            self.automaton, self.met = None, {}
            keep = usable[self.ids]
            self.keys, self.ids = self.keys[keep], self.ids[keep]
            self.sieve = _sieve(self.keys)
        self.places = _places(self.keys)
        del self.symbols, self.merges

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        out = np.full(len(a), NEVER)
        maybe = np.flatnonzero(self.pair_sieve[_slot(key)])
        at = _found(self.pair_keys, self.pair_places, key[maybe])
        hit = self.pair_keys[at] == key[maybe]
        out[maybe[hit]] = self.pair_rank[at[hit]]
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b stays apart from piece a before it (-1: nothing is before it).

        Both are unmerged again, the later merge first: at each step a merge across the boundary, had it come before
        the one undone, would have been made.
        """
        out = np.ones(len(a), bool)
        live = np.flatnonzero(a >= 0)
        a, b, limit = a[live], b[live], np.full(len(live), NEVER)
        while len(live):
            joined = self._pair_rank(a, b) < limit
            out[live[joined]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~joined & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def advance(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words of one length, (words, length): last piece, its length and number of pieces, by prefix and word."""
        n, length = codes.shape
        hashes = np.ascontiguousarray(prefix_hashes(codes).T)
        last, back, count = (np.full((length + 1, n), v, np.int32) for v in (-1, 0, 0))
        best = np.zeros((length + 1, n), np.float32)
        rows = np.arange(n)
        for j in range(1, length + 1):
            m = min(j, self.longest)
            spans = hashes[j] - hashes[j - m : j] * self.powers[m:0:-1, None]
            k, row = np.nonzero(self.sieve[_slot(spans)])
            key = spans[k, row]
            at = _found(self.keys, self.places, key)
            hit = np.flatnonzero(self.keys[at] == key)
            row, k, piece = row[hit], k[hit], self.ids[at[hit]]
            if self.scores is None:
                fit = self.fits(last[j - m + k, row], piece)
                row, k, piece = row[fit], k[fit], piece[fit]
                last[j, row], back[j, row] = piece, m - k  # the maximum of one 0 and minus infinities
            else:
                values, found = np.full((m, n), -np.inf, np.float32), np.full((m, n), -1, np.int32)
                values[k, row], found[k, row] = best[j - m + k, row] + self.scores[piece], piece
                top = values.argmax(0)
                last[j], back[j], best[j] = found[top, rows], m - top, values[top, rows]
            count[j] = count[j - back[j], rows] + 1
        return last, back, count

    def __getstate__(self):
        return self.__dict__ | {"automaton": None, "met": {}}

    def alone(self, codes: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        """What advance() gives for one long word of a merged vocabulary, position by position: an automaton lists the pieces that
        end there, and whether a piece fits behind another is looked up once."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for piece, i in self.strings.items():
                self.automaton.add_word(piece, (len(piece), i))
            self.automaton.make_automaton()
        met, done = self.met, 0
        last, back, count = ([v] * (len(codes) + 1) for v in (-1, 0, 0))
        for end, (length, piece) in self.automaton.iter("".join(map(chr, codes.tolist()))):
            j = end + 1
            if j == done:
                continue
            pair = (last[j - length], piece)
            fit = met.get(pair)
            if fit is None:
                fit = met[pair] = bool(self.fits(*(np.array([x]) for x in pair))[0])
            if fit:
                done, last[j], back[j], count[j] = j, piece, length, count[j - length] + 1
        if len(met) > ELEMENTS:
            met.clear()
        return last, back, count

    def lone(self, words: list) -> set[int]:
        return {i for i, w in enumerate(words) if len(w) > LONE} if self.scores is None else set()

    def groups(self, words: list, to_codes) -> Iterator[tuple[list[int], np.ndarray]]:
        """Indexes of words of one length, and their codes, in blocks of bounded size; lone ones are left out."""
        by_length: dict[int, list[int]] = {}
        lone = self.lone(words)
        for i, w in enumerate(words):
            if i in lone:
                continue
            by_length.setdefault(len(w), []).append(i)
        for length, own in by_length.items():
            block = max(1, ELEMENTS // (length * min(length, self.longest)))
            for start in range(0, len(own), block):
                part = own[start : start + block]
                yield part, to_codes([words[i] for i in part]).reshape(len(part), length)

    def parts_of(self, words: list, to_codes) -> tuple[list, np.ndarray]:
        """Words cut where no piece holds the two symbols beside the cut, if they are long, and of which word each part is.
        Merging, which never crosses such a place, gives a word's parts what it gives the word; scores, whose sums are
        rounded along the word, are left whole."""
        parts, of = [], []
        for i, w in enumerate(words):
            if len(w) <= LONG or self.scores is not None:
                parts.append(w)
                of.append(i)
                continue
            codes = to_codes([w]).astype(np.uint64)
            pair = codes[:-1] << np.uint64(32) | codes[1:]
            at = np.minimum(np.searchsorted(self.inner, pair), len(self.inner) - 1)
            cuts = [0, *(np.flatnonzero(self.inner[at] != pair) + 1).tolist(), len(w)]
            parts += [w[x:y] for x, y in zip(cuts, cuts[1:])]
            of += [i] * (len(cuts) - 1)
        return parts, np.array(of, np.int64)

    def _joined(self, words: list, of: np.ndarray, out: list, add) -> list:
        if len(of) == len(words):
            return out
        start = np.searchsorted(of, np.arange(len(words) + 1))
        return [out[x] if y == x + 1 else add(out[x:y]) for x, y in zip(start, start[1:])]

    def ids_of(self, words: list, to_codes) -> list[np.ndarray]:
        """The ids of each word's pieces, in the order of words."""
        return [np.frombuffer(x, np.int32) for x in self.bytes_of(words, to_codes, np.int32)]

    def bytes_of(self, words: list, to_codes, kind: type) -> list[bytes]:
        """The same as bytes of numbers of a kind."""
        parts, of = self.parts_of(words, to_codes)
        out: list = [None] * len(parts)
        for i in self.lone(parts):
            last, back, _ = self.alone(to_codes([parts[i]]))
            own, at = [], len(last) - 1
            while at > 0:
                own.append(last[at])
                at -= back[at]
            out[i] = np.array(own[::-1], kind).tobytes()
        for part, codes in self.groups(parts, to_codes):
            last, back, count = self.advance(codes)
            rows, at, steps = np.arange(len(part)), np.full(len(part), codes.shape[1]), []
            while (at > 0).any():
                steps.append(np.where(at > 0, last[at, rows], -1))
                at = np.where(at > 0, at - back[at, rows], 0)
            ids = np.stack(steps[::-1], 1)
            flat = ids[ids >= 0].astype(kind).tobytes()
            ends = (np.cumsum(count[-1]) * np.dtype(kind).itemsize).tolist()
            for i, x, y in zip(part, [0, *ends], ends):
                out[i] = flat[x:y]
        return self._joined(words, of, out, b"".join)

    def prefixes_of(self, words: list, to_codes) -> list[np.ndarray]:
        """The number of pieces of every prefix of each word, the empty one first."""
        parts, of = self.parts_of(words, to_codes)
        out: list = [None] * len(parts)
        for i in self.lone(parts):
            out[i] = np.array(self.alone(to_codes([parts[i]]))[2], np.int32)
        for part, codes in self.groups(parts, to_codes):
            for i, x in zip(part, np.ascontiguousarray(self.advance(codes)[2].T), strict=True):
                out[i] = x

        def add(own: list[np.ndarray]) -> np.ndarray:
            before = np.cumsum([0, *(x[-1] for x in own)])
            return np.concatenate([own[0][:1], *(x[1:] + n for x, n in zip(own, before))])

        return self._joined(words, of, out, add)


def merge(ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> tuple[list[int], tuple[int, int, int] | None]:
    """Merges neighbours, lowest rank and then leftmost first. pairs: (left, right) to (rank, merged). Returns the
    ids left and the last merge's (left, right, rank)."""
    nxt, prv, alive = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)], [True] * len(ids)
    ids, last = list(ids), None
    heap = [(pairs[p][0], i, pairs[p][1], p) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
    heapq.heapify(heap)
    while heap:
        rank, i, merged, pair = heapq.heappop(heap)
        j = nxt[i] if alive[i] else -1
        if j < 0 or (ids[i], ids[j]) != pair:
            continue
        last, ids[i], alive[j], nxt[i] = (*pair, rank), merged, False, nxt[j]
        if nxt[j] >= 0:
            prv[nxt[j]] = i
        for a, b in ((prv[i], i), (i, nxt[i])):
            if a >= 0 and b >= 0 and (p := (ids[a], ids[b])) in pairs:
                r, m = pairs[p]
                heapq.heappush(heap, (r, a, m, p))
    return [x for x, ok in zip(ids, alive, strict=True) if ok], last
