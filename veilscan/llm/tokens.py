"""Token ids of whole texts by a public tokenizer, with a memo of the words seen."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from veilscan.llm.common import MEMO_KEY, MEMO_WORDS, kept

#: Anything that may join letters and signs or change under normalisation: contractions, special
#: tokens, and characters beyond ASCII, Latin-1 letters and common punctuation; also the ASCII separators,
#: which only str.split() takes for white space.
UNSAFE = re.compile(r"'|<\||[^\x00-\x1B\x20-\x7FÀ-ÿ–—‘’“”…•€]")
SEPARATORS = "\x1c", "\x1d", "\x1e", "\x1f"
#: In a text without those, tokens lie within a run of letters or a run of other signs.
LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
SPACE = re.compile(r"[\t-\r ]")
#: By 16-bit character: 1 for letters, 2 for white space, 0 for other signs.
KIND = np.zeros(1 << 16, np.uint8)
KIND[[i for i in range(256) if LETTERS.match(chr(i))]] = 1
KIND[[i for i in range(256) if SPACE.match(chr(i))]] = 2


def default_tokenizer() -> str:
    """Path of the tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def is_safe(text: str) -> bool:
    if text.isascii():
        return not ("'" in text or "<|" in text or any(c in text for c in SEPARATORS))
    return not UNSAFE.search(text)


def runs_of(text: str) -> list[str]:
    """Runs of letters and of other signs of a safe text, lower-cased: a space goes in wherever the kind of characters
    changes, and the text is split at white space, which takes far less time than a regular expression."""
    chars = np.frombuffer(text.lower().encode("utf-16-le"), "<u2")
    kind = KIND[chars]
    spaced, stays = np.full(2 * len(chars), 32, "<u2"), np.ones(2 * len(chars), bool)
    spaced[1::2] = chars
    stays[:1] = False
    stays[2::2] = kind[1:] != kind[:-1]
    return spaced[stays].tobytes().decode("utf-16-le").split()


class Encoder:
    """Encodes whole texts; equal to the library's encode(text, add_special_tokens=False).ids.

    This tokenizer lower-cases, drops white space and splits a text into runs of letters, single digits
    and runs of signs. So the ids of a text are those of its runs, one after the other, and a run met
    before costs a lookup. Texts with characters where that is not plain to see are cut at ASCII white
    space only, which no token crosses, and each piece goes to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Bytes that an id needs in a file.
        self.width = 2 if max(self.tokenizer.get_vocab().values()) < 1 << 16 else 4
        #: How the model spells letters beyond ASCII.
        letters = [c for c in map(chr, range(128, 256)) if LETTERS.match(c)]
        self.letters = str.maketrans({c: "".join(part for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c)) for c in letters})
        self.runs: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, runs: list[str]) -> None:
        """A run of letters is one word to the library, which its model takes as it is: no need to normalise and
        split it again."""
        tokenize = self.tokenizer.model.tokenize
        words = [r for r in runs if LETTERS.match(r)]
        for run in words:
            self.runs[run] = array("I", [t.id for t in tokenize(run if run.isascii() else run.translate(self.letters))]).tobytes()
        others = [r for r in runs if not LETTERS.match(r)]
        for run, ids in zip(others, self._library(others)):
            self.runs[run] = array("I", ids).tobytes()

    def _by_pieces(self, text: str) -> bytes:
        if len(self.pieces) > MEMO_WORDS:
            self.pieces.clear()
        cut = text.encode().split()
        if need := list({p for p in cut if p not in self.pieces}):
            for piece, ids in zip(need, self._library([p.decode() for p in need])):
                self.pieces[piece] = array("I", ids).tobytes()
        joined = b"".join(map(self.pieces.__getitem__, cut))
        # in scripts without white space a piece may be a whole text
        for piece in need:
            if len(piece) > MEMO_KEY:
                del self.pieces[piece]
        return joined

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.runs) > MEMO_WORDS:
            self.runs, self.older = {}, self.runs
        cut = [runs_of(t) if is_safe(t) else None for t in texts]
        if need := set().union(*(c for c in cut if c)).difference(self.runs):
            known = need & self.older.keys()
            self.runs.update((r, self.older[r]) for r in known)
            self._learn(list(need - known))
        get = self.runs.__getitem__
        out = [self._by_pieces(t) if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut)]
        for run in need:
            if len(run) > MEMO_KEY:
                del self.runs[run]
        return out


def encoder_for(path: str) -> Encoder:
    """One encoder a worker process, so that a task goes on with the words that earlier ones have met."""
    return kept(f"encoder {path}", lambda: Encoder(path))
