"""Byte-level BPE ids of whole texts, with a cache of the ids of words."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: White space other than spaces and line ends, as either Python or the pattern's engine sees it.
OTHER_WHITE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"
#: White space beside a space or a line end: there words cannot be split off without changing ids.
ODD = re.compile(r"\s[ \n]|[ \n]\s")
#: Latin letters, ASCII punctuation and the rest of each word, words ending in NUL: without a rest, the tokenizer makes one
#: piece of the letters and one of the punctuation.
LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]*)([!-&(-/:-@\[-`{-~]*)([^\0]*)\0")
#: Words that a worker remembers in each of two generations.
CACHED = 350_000
#: Characters that are encoded at a time; longer texts are cut before a space or line end, where words don't depend on each other.
CHUNK = 4_000_000


def byte_chars() -> np.ndarray:
    """How byte-level vocabularies write a byte: printable Latin-1 as itself, others from U+0100 on in their order. Here
    0 stands for the border of two words and 1 for a space."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    chars = np.array([b if b in plain else 256 + other.index(b) for b in range(256)], "<u4")
    chars[:2] = ord(" "), chars[0x20]
    return chars


BYTE_CHARS = byte_chars()


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def is_odd(text: str) -> bool:
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return True
    return any(c in text for c in OTHER_WHITE) and ODD.search(text) is not None


class WordCache:
    """Ids of words as bytes of unsigned 32-bit integers.

    The byte-level pattern never matches across the border between a character and a following space or line end, and
    never looks back. So a text whose white space stands alone is the concatenation of its words, each with its white
    space in front; other texts go to the tokenizer whole. A key is a word without its space, or with its line end.
    Words not used for a while are forgotten, so memory stays bounded.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        #: The same ids for words of letters alone whose bytes are already written as the vocabulary writes them.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        #: Ids that hold a space, which of a word's ids only the first does.
        self.starts = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.starts[[i for t, i in self.tokenizer.get_vocab().items() if t[:1] == "Ġ"]] = True
        self.ids: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _letters(self, words: list[str]) -> None:
        raw = np.frombuffer(("\1" + "\0\1".join(words)).encode(), np.uint8)
        text, most = BYTE_CHARS[raw].tobytes().decode("utf-32-le"), 1 << 14
        cuts, at = [0], 0
        while at < len(text) and (at := text.find(" ", at + most)) >= 0:
            cuts.append(at)
        parts = [text[lo:hi] for lo, hi in zip(cuts, [*cuts[1:], len(text)])]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.letters.encode_batch_fast(parts, add_special_tokens=False)])
        at, ids = np.flatnonzero(self.starts[ids]) * 4, ids.tobytes()
        at = [*at.tolist(), len(ids)]
        self.ids.update(zip(words, [ids[lo:hi] for lo, hi in zip(at, at[1:])], strict=True))

    def learn(self, words: list[str]) -> None:
        """Adds these words, which it lacks."""
        here, old = self.ids, self.old
        if old:
            words, known = [], words
            for w, ids in zip(known, map(old.get, known)):
                if ids is None:
                    words.append(w)
                else:
                    here[w] = ids
        latin, other = [], []
        if words and "".join(words).find("\0") >= 0:
            other = [w for w in words if "\0" in w]
            words = [w for w in words if "\0" not in w]
        for w, parts in zip(words, LATIN.findall("\0".join(words) + "\0")):
            if parts[0] and not parts[2]:
                latin.append((w, *parts[:2]))
            else:
                other.append(w)
        cores = set([x[1] for x in latin]).difference(here)
        if old:
            again = {w: ids for w, ids in zip(cores, map(old.get, cores)) if ids is not None}
            here.update(again)
            cores.difference_update(again)
        if cores:
            self._letters(list(cores))
        for w, core, tail in latin:
            if tail:
                if (ids := self.tails.get(tail)) is None:
                    ids = self.whole(tail)
                    if len(self.tails) < 10_000:
                        self.tails[tail] = ids
                here[w] = here[core] + ids
        if other:
            plain = [w if w[:1] == "\n" else f" {w}" for w in other]
            for w, e in zip(other, self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)):
                here[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        return [ids for some in self.chunks(texts) for ids in some]

    def chunks(self, texts: list[str]) -> Iterator[list[bytes]]:
        """Ids of successive texts, about CHUNK characters at a time."""
        held, size = [], 0
        for t in texts:
            if held and size + len(t) > CHUNK:
                yield self._chunk(held)
                held, size = [], 0
            held.append(t)
            size += len(t)
        if held:
            yield self._chunk(held)

    def _chunk(self, texts: list[str]) -> list[bytes]:
        out, plain = [b""] * len(texts), []
        for i, t in enumerate(texts):
            if is_odd(t):
                out[i] = self.whole(t)
            elif len(t) <= CHUNK:
                plain.append(i)
            else:
                out[i] = b"".join(x for piece in slices(t) for x in self._words([piece]))
        for i, ids in zip(plain, self._words([texts[i] for i in plain])):
            out[i] = ids
        return out

    def _words(self, texts: list[str]) -> list[bytes]:
        """Ids of texts whose white space stands alone: distinct words are looked up, then laid out in the texts' order."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not texts:
            return []
        if len(self.ids) > CACHED:
            self.old, self.ids = self.ids, {}
        split = pc.split_pattern(pa.array([t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        at, coded = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        place, words = coded.indices.to_numpy().copy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        first = [words[i] for i in place[at[:-1]].tolist()]  # these have no space in front
        place[at[:-1]] = np.arange(len(words), len(words) + len(first))
        parts, here = list(map(self.ids.get, words)), self.ids
        if new := [i for i, x in enumerate(parts) if x is None]:
            self.learn([words[i] for i in new])
            for i in new:
                parts[i] = here[words[i]]
        parts += [self.whole(w) if w else b"" for w in first]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat, n = np.frombuffer(b"".join(parts), "<u4"), size[place]
        ends = np.cumsum(n)
        source = np.repeat((np.cumsum(size) - size)[place] - (ends - n), n)
        source += np.arange(len(source))
        ids, cut = flat[source].tobytes(), (np.append(0, ends)[at] * 4).tolist()
        del split, coded
        pa.default_memory_pool().release_unused()  # what Arrow took goes back, since workers live on
        return [ids[lo:hi] for lo, hi in zip(cut, cut[1:])]


def slices(text: str) -> Iterator[str]:
    """Parts of about CHUNK characters, each but the first beginning with a space or line end."""
    start = 0
    while len(text) - start > CHUNK:
        cuts = [i for i in (text.find(" ", start + CHUNK), text.find("\n", start + CHUNK)) if i >= 0]
        if not cuts:
            break
        yield text[start : min(cuts)]
        start = min(cuts)
    yield text[start:]


@lru_cache(1)
def word_cache(file: str) -> WordCache:
    """One for each Python worker, kept between its tasks."""
    return WordCache(file)
