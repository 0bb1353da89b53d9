"""A double-array trie of vocabulary pieces and batched dynamic programming over all segmentations of words."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

#: The white-space marker of piece vocabularies.
MARK = "▁"
#: Longer byte strings are walked one by one, not in a matrix.
LONG = 96


class DoubleArrayTrie:
    """States s with a transition on byte b to base[s] + b + 1 where check agrees; value is the piece that ends there."""

    def __init__(self, pieces: dict[bytes, int]):
        base, check, value = [1], [-1], [-1]
        free, crowded = 258, 258  # so that bases are positive; below `crowded` only single children still look for room

        def room(n: int) -> None:
            if n > len(check):
                more = n - len(check) + 1024
                base.extend([0] * more), check.extend([-1] * more), value.extend([-1] * more)

        room(1200)
        keys = sorted(pieces)
        todo = [(0, 0, len(keys), 0)]  # state, range of keys, depth
        for state, lo, hi, depth in todo:
            if len(keys[lo]) == depth:
                value[state] = pieces[keys[lo]]
                lo += 1
            kids, i = [], lo
            while i < hi:
                b, j = keys[i][depth], i
                while j < hi and keys[j][depth] == b:
                    j += 1
                kids.append((b + 1, i, j))
                i = j
            if not kids:
                continue
            while check[free] != -1:
                free += 1
                room(free + 600)
            at = max(1, (free if len(kids) == 1 else max(free, crowded)) - kids[0][0])
            tries = 0
            while True:
                tries += 1
                if tries % 64 == 0:
                    crowded = at
                room(at + 600)
                if all(check[at + b] == -1 for b, _, _ in kids):
                    break
                at += 1
            base[state] = at
            for b, i, j in kids:
                check[at + b] = state
                todo.append((at + b, i, j, depth + 1))
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, value))

    def prefixes(self, text: bytes, start: int) -> list[tuple[int, int]]:
        """(end, piece) of all pieces that begin at start."""
        s, found = 0, []
        for i in range(start, len(text)):
            t = int(self.base[s]) + text[i] + 1
            if self.check[t] != s:
                break
            s = t
            if self.value[s] >= 0:
                found.append((i + 1, int(self.value[s])))
        return found


def char_bytes(lead: int) -> int:
    """Bytes of the UTF-8 character with this first byte."""
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


CHAR_BYTES = np.array([0, *map(char_bytes, range(256))], np.int64)


class Vocabulary:
    """Pieces of a public vocabulary file with their log scores.

    Scores of a unigram file are its own. A file of merges has only ranks; rank r then gets the Zipf log score
    -log(r + 2), less the log of their sum, so frequent pieces stay likely. Fitted to no data.
    """

    def __init__(self, file: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=file)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.full(256, -1, np.int64)
        normal = {}
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal[p.encode()] = i
        self.unknown = sp.unk_id()
        self.scores = np.array([sp.get_score(i) for i in range(n)])
        own = np.array(sorted(normal.values()))
        if len(own) and np.all(self.scores[own] == np.round(self.scores[own])):
            order = own[np.argsort(-self.scores[own], kind="stable")]
            zipf = -np.log(np.arange(len(own)) + 2.0)
            self.scores[order] = zipf - np.log(np.exp(zipf).sum())
        #: Score of a character that no piece covers, spelt in bytes: below every piece, as unigram encoders have it.
        self.unknown_score = float(self.scores[own].min() - 10) if len(own) else -10.0
        self.trie = DoubleArrayTrie(normal)
        self.longest = max(map(len, normal), default=1)
        self.crosses = any(MARK in p[1:] and p.strip(MARK) for p in (k.decode() for k in normal) if MARK in p.lstrip(MARK))
        self.lines = any(b"\n" in k and len(k) > 1 for k in normal)

    def best(self, words: list[bytes]) -> list[bytes]:
        """Ids of the best segmentation of each word, as bytes of unsigned 32-bit integers. Of equal ones, the earlier found."""
        out: list[bytes | None] = [None] * len(words)
        order = sorted((i for i, w in enumerate(words) if 0 < len(w) <= LONG), key=lambda i: len(words[i]))
        for lo in range(0, len(order), 4096):
            some = order[lo : lo + 4096]
            for i, ids in zip(some, self._best([words[i] for i in some])):
                out[i] = ids
        return [self.best_of_long(w) if x is None else x for w, x in zip(words, out)]

    def _best(self, words: list[bytes]) -> list[bytes]:
        codes, lengths = matrix(words)
        n, most = codes.shape
        score = np.full((n, most + 1), -np.inf)
        score[:, 0] = 0
        prev, piece = np.zeros((n, most + 1), np.int32), np.full((n, most + 1), -1, np.int32)
        for s in range(most):
            rows = np.flatnonzero((codes[:, s] > 0) & (score[:, s] > -np.inf))
            if not len(rows):
                continue
            size = CHAR_BYTES[codes[rows, s]]
            lone = np.ones(len(rows), bool)
            for end, at, ids in walk(self.trie, codes, rows, s):
                own = rows[at]
                lone[at[size[at] == end - s]] = False
                new = score[own, s] + self.scores[ids]
                up = new > score[own, end]
                own = own[up]
                score[own, end], prev[own, end], piece[own, end] = new[up], s, ids[up]
            own, end = rows[lone], np.minimum(s + size[lone], lengths[rows[lone]])
            new = score[own, s] + self.unknown_score
            up = new > score[own, end]
            own, end = own[up], end[up]
            score[own, end], prev[own, end], piece[own, end] = new[up], s, -1
        out = []
        prev_, piece_ = prev.tolist(), piece.tolist()
        for w, at, p, q in zip(words, lengths.tolist(), prev_, piece_):
            ids = []
            while at:
                start = p[at]
                ids.append(q[at]) if q[at] >= 0 else ids.extend(self.spelt(w[start:at])[::-1])
                at = start
            out.append(np.array(ids[::-1], "<u4").tobytes())
        return out

    def spelt(self, char: bytes) -> list[int]:
        ids = self.byte_ids[list(char)].tolist()
        return [self.unknown] if -1 in ids else ids

    def best_of_long(self, word: bytes) -> bytes:
        score = [-math.inf] * (len(word) + 1)
        score[0], prev, piece = 0.0, [0] * (len(word) + 1), [-1] * (len(word) + 1)
        for s in range(len(word)):
            if score[s] == -math.inf:
                continue
            one = min(s + char_bytes(word[s]), len(word))
            found = self.trie.prefixes(word, s)
            for end, i in [*found, *([] if any(end == one for end, _ in found) else [(one, -1)])]:
                new = score[s] + (float(self.scores[i]) if i >= 0 else self.unknown_score)
                if new > score[end]:
                    score[end], prev[end], piece[end] = new, s, i
        ids, at = [], len(word)
        while at:
            ids.extend([piece[at]] if piece[at] >= 0 else self.spelt(word[prev[at] : at])[::-1])
            at = prev[at]
        return np.array(ids[::-1], "<u4").tobytes()


def matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes plus one of each word, padded with zeros; their lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.zeros((len(words), int(lengths.max()) + 1), np.int16)
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int16) + 1
    rows = np.repeat(np.arange(len(words)), lengths)
    codes[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return codes, lengths


def walk(trie: DoubleArrayTrie, codes: np.ndarray, rows: np.ndarray, start: int):
    """Pieces that begin at start, by their end: yields end, positions in rows, piece ids."""
    at, state, end = np.arange(len(rows)), np.zeros(len(rows), np.int32), start
    while len(at) and end < codes.shape[1]:
        code = codes[rows[at], end]
        to = trie.base[state] + code
        ok = (code > 0) & (trie.check[to] == state)
        at, state, end = at[ok], to[ok], end + 1
        ids = trie.value[state]
        if len(hit := np.flatnonzero(ids >= 0)):
            yield end, at[hit], ids[hit]


@lru_cache(2)
def vocabulary(file: str) -> Vocabulary:
    """One for each Python worker, kept between its tasks."""
    return Vocabulary(file)
