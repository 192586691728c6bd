"""Whole-text token ids by the tokenizers library, with a cache of pieces.

Both vocabularies cut a text into independent parts wherever a space or a newline follows a
character that is no white space: their patterns put white space only at the front of a part,
look at nothing to the left of it, and normalisation neither joins nor reorders across it.
So the library encodes each different piece once and a text's ids are its pieces' ids in a row.
A text with white space before a space or newline, or with an added token, is encoded whole:
the library takes added tokens out of a text before anything else.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np

#: Pieces kept by a worker process at most; a full cache is emptied, which changes no result.
CACHE = 800_000
#: Words that are encoded together.
RUN = 64

class PieceEncoder:
    """ids(texts): for each text the little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # in capitals too: making small letters must not turn other text into an added token
        self.marks = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)", re.IGNORECASE)
        # words to the tokenizer in a newline and a letter: one where white space is dropped
        self.newline_words = len(set(self.tokenizer.encode("\na", add_special_tokens=False).word_ids))
        self.lowers = "Lowercase" in str(self.tokenizer.normalizer)
        self.cache: dict[str, bytes] = {}  # of what follows a space, by itself, or of a piece that starts with a newline
        self.stems: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}  # of pieces at the start of a text, with no space in front

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new_stems(self, stems: list[str]) -> None:
        """Encodes stems of letters in runs, as neighbouring words of one text, and all others one by one."""
        runs: dict[str, list[str]] = {" ": [], "\n": [], "": []}
        for s in stems:
            runs[s[0] if s[:1] in (" ", "\n") and s[1:].isalpha() else ""].append(s)
        for front, per in ((" ", 1), ("\n", self.newline_words)):
            words = runs[front]
            groups = [words[i : i + RUN] for i in range(0, len(words), RUN)]
            for i in range(0, len(groups), 64):
                some = groups[i : i + 64]
                for group, e in zip(some, self.tokenizer.encode_batch(["".join(g) for g in some], add_special_tokens=False), strict=True):
                    at = np.flatnonzero(np.diff(np.asarray(e.word_ids, np.int64), prepend=-1)) * 4
                    if len(at) != per * len(group):  # some word is not one word to the tokenizer
                        runs[""] += group
                        continue
                    raw, at = array("I", e.ids).tobytes(), at[::per].tolist()
                    self.stems.update(zip(group, [raw[x:y] for x, y in zip(at, [*at[1:], None], strict=True)], strict=True))
        rest = runs[""]
        for i in range(0, len(rest), 4096):
            self.stems.update(zip(rest[i : i + 4096], self._encode(rest[i : i + 4096]), strict=True))

    def _fill(self, cache: dict[str, bytes], wanted: set[str], front: str) -> None:
        missing = list(wanted.difference(cache))
        if len(cache) + len(missing) > CACHE:
            cache.clear()
            missing = list(wanted)
        whole = [p if p[:1] == "\n" else front + p for p in missing]
        # a letter or digit and a full stop or comma never share a part, so a piece's stem serves all its endings
        stems = [w.rstrip(".,") for w in whole]
        stems = [s if s and s[-1].isalnum() and s[-1].lower().isalnum() else w for s, w in zip(stems, whole, strict=True)]
        ends = [w[len(s) :] for s, w in zip(stems, whole, strict=True)]
        needed = {*stems, *ends}
        new = list(needed.difference(self.stems))
        if len(self.stems) + len(new) > CACHE:
            self.stems.clear()
            new = list(needed)
        self._new_stems(new)
        get = self.stems.__getitem__
        cache.update(zip(missing, [get(s) + get(e) if e else get(s) for s, e in zip(stems, ends, strict=True)], strict=True))

    def _lowered(self, text: str) -> str:
        """The text in small letters where the vocabulary makes them so anyway and each Latin-1 letter has its own: fewer different pieces."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()

    def ids(self, texts: list[str]) -> list[bytes]:
        marked = [i for i, t in enumerate(texts) if self.marks.search(t)]
        if marked:
            whole = dict(zip(marked, self._encode([texts[i] for i in marked]), strict=True))
            others = iter(self._pieced([t for i, t in enumerate(texts) if i not in whole]))
            return [whole[i] if i in whole else next(others) for i in range(len(texts))]
        return self._pieced(texts)

    def _pieced(self, texts: list[str]) -> list[bytes]:
        """ids of texts without added tokens."""
        if self.lowers:
            texts = [self._lowered(t) for t in texts]
        pieces: list[list[str] | None] = [t.replace("\n", " \n").split(" ") for t in texts]
        heads, inner, ends = set(), set(), set()
        for p in pieces:
            heads.add(p[0])
            inner.update(p[1:-1])
            ends.add(p[-1])
        # a space or newline after white space is no cut: such texts are encoded whole
        loose = {p for p in inner | heads if p[-1:].isspace()} | ({""} & inner)
        if loose:
            pieces = [None if len(p) > 1 and not (loose.isdisjoint(p[1:-1]) and not p[0][-1:].isspace()) else p for p in pieces]
            heads, inner = heads - loose, inner - loose
        heads |= {p[0] for p in pieces if p}
        self._fill(self.heads, heads, "")
        self._fill(self.cache, inner | ends, " ")
        get = self.cache.__getitem__
        return [self._encode([t])[0] if p is None else self.heads[p[0]] + b"".join(map(get, p[1:])) for t, p in zip(texts, pieces, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder a worker process and vocabulary; its cache serves all tasks of that process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return PieceEncoder(path)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
