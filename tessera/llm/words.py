"""Token ids of whole texts by the public word tokenizer, encoded piece by piece.

The tokenizer removes white space and cuts texts into pieces before it merges
anything, and neither its normalisation nor its merges reach across a piece. So
the ids of a text are the ids of its pieces in order, and each distinct piece
needs encoding once. Texts of plain Latin letters are cut here and their pieces
go straight to the tokenizers library's BPE model; words with any other
character, and all that could hold a special string, go through its whole encoder.

Ids are held as little-endian unsigned 16-bit values where the vocabulary
allows, else as 32-bit ones (``WordEncoder.dtype``).
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Distinct pieces a worker remembers before it starts afresh; bounds its memory.
CACHE_PIECES = 500_000
_LETTERS = "!-;=?-~À-ÖØ-öø-įĲ-ǃ¡-§«»¿"
PLAIN_WORD = re.compile(f"[{_LETTERS}]*\\Z").match
PLAIN_TEXT = re.compile(f"[{_LETTERS} \n\t\r]*\\Z").match
#: The tokenizer's own split pattern, a fixed value, in the terms of ``re`` over the plain characters above.
split_plain = re.compile("[a-zß-öø-ʯ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-zß-öø-ʯ0-9 \n\t\r]+").findall
_encoders: dict[str, "WordEncoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def units(text: str) -> list[str]:
    """The pieces of a text in order; a word that isn't plain comes whole, behind a space."""
    if PLAIN_TEXT(text):
        return split_plain(text.lower())
    out: list[str] = []
    for w in text.replace("\n", " ").split(" "):
        if PLAIN_WORD(w):
            out += split_plain(w.lower())
        else:
            out.append(" " + w)
    return out


def in_groups(many: list[str], characters: int = 200_000):
    """The units of texts, some texts at a time, that together have about so many characters."""
    at = 0
    while at < len(many):
        size, end = 0, at
        while end < len(many) and (size < characters or end == at):
            size += len(many[end])
            end += 1
        yield [units(x) for x in many[at:end]]
        at = end


class WordEncoder:
    """``encode(text)``: the ids as bytes of ``dtype``."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        # the same model behind the plainest split: pieces come here already cut
        self.fast = Tokenizer.from_file(path)
        self.fast.normalizer = None
        self.fast.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.vocab_size = n = self.full.get_vocab_size()
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.ends = np.array([(self.full.id_to_token(i) or "").endswith("</w>") for i in range(n)])
        self.cache_pieces = cache_pieces
        self.known: dict[str, bytes] = {}

    def learn(self, new: set[str]) -> None:
        """Encode units that are not known yet."""
        known, width = self.known, self.dtype.itemsize
        odd = [u for u in new if u[0] == " "]
        for u, e in zip(odd, self.full.encode_batch_fast([u[1:] for u in odd], add_special_tokens=False) if odd else []):
            known[u] = np.array(e.ids, self.dtype).tobytes()
        if fresh := [u for u in new if u[0] != " "]:
            ids = np.array(self.fast.encode_batch_fast([" ".join(fresh)], add_special_tokens=False)[0].ids, self.dtype)
            ends = (width * np.r_[0, np.flatnonzero(self.ends[ids]) + 1]).tolist()
            if len(ends) != len(fresh) + 1:
                raise ValueError("a piece without its end of word")
            raw = ids.tobytes()
            known.update(zip(fresh, map(raw.__getitem__, map(slice, ends, ends[1:]))))

    def prepare(self, cut: list[list[str]]) -> None:
        """Learn what is new in texts that are already cut."""
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > self.cache_pieces:
            self.known.clear()
            new = set().union(*cut)
        self.learn(new)

    def encode(self, text: str) -> bytes:
        return next(self.encode_many([text]))

    def encode_many(self, many: list[str]):
        """Encode texts in order."""
        for cut in in_groups(many):
            self.prepare(cut)
            get = self.known.__getitem__
            for own in cut:
                yield b"".join(map(get, own))

    def ids(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.dtype)


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
