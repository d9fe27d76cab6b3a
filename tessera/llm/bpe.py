"""Byte-level BPE by backtracking over longest matches.

The vocabulary's byte strings are mapped to Latin-1 characters and put into a
pyahocorasick automaton. A piece is encoded from the left: the longest token
that matches comes first, a shorter prefix of it next, and a token may follow
another only if BPE would leave that very pair unmerged. Whether it would is
found by undoing the two tokens' merges from the latest on and asking whether a
merge across the seam would have come earlier; answers are remembered. A
position from which no way led on is marked and not tried again, so the work is
linear in the piece. Results equal those of merging lowest ranks first.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import quoted, text_of, texts

CACHE_PIECES = 500_000
#: Longer pieces are not remembered.
CACHE_LENGTH = 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """The definition: join the adjacent pair of lowest rank, leftmost first, as long as there is one."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min((r for a, b in zip(parts, parts[1:]) if (r := ranks.get(a + b)) is not None and (below is None or r < below)), default=None)
        if best is None:
            break
        i = next(i for i in range(len(parts) - 1) if ranks.get(parts[i] + parts[i + 1]) == best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Seams:
    """Which two tokens merging leaves side by side.

    ``halves[t]``: the two tokens whose merge makes ``t``; ``joined`` is its inverse.
    Merged tokens are numbered in the order of their merges.
    """

    def __init__(self, halves: dict[int, tuple[int, int]]):
        self.halves = halves
        self.joined = {pair: t for t, pair in halves.items()}
        self.known: dict[tuple[int, int], bool] = {}

    def holds(self, left: int, right: int) -> bool:
        key = left, right
        if (known := self.known.get(key)) is None:
            if len(self.known) > 500_000:
                self.known.clear()
            known = self.known[key] = self._holds(left, right)
        return known

    def _holds(self, left: int, right: int) -> bool:
        # Undo merges next to the seam, latest first. ``before``: a merge across the seam
        # counts only if it comes earlier than the merge that was undone last; of two equal
        # ranks the leftmost happens first, which is the left token's own merge.
        before = float("inf")
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < before:
                return False
            a, b = self.halves.get(left), self.halves.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                before, left = left, a[1]
            else:
                before, right = right + 0.5, b[0]


class BytePairCodec:
    """Encodes pieces and whole texts, and decodes ids, for one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.find = regex.compile(pattern).findall
        # a token that merging never reaches has no halves and is left out
        halves: dict[int, tuple[int, int]] = {}
        trie = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = merge_by_rank(token, ranks, rank)
                if len(parts) != 2:
                    continue
                halves[rank] = ranks[parts[0]], ranks[parts[1]]
            trie.add_word(token.decode("latin-1"), rank)
        trie.make_automaton()
        self.trie = trie
        self.seams = Seams(halves)
        self.shorter: dict[int, int | None] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def next_shorter(self, token: int) -> int | None:
        """The longest proper prefix of a token that is a token."""
        if token not in self.shorter:
            b = self.bytes_of[token]
            self.shorter[token] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks and (n == 1 or self.ranks[b[:n]] in self.seams.halves)), None)
        return self.shorter[token]

    def longest(self, text: str, at: int) -> int:
        return next(self.trie.iter_long(text, at))[1]

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        text, n = piece.decode("latin-1"), len(piece)
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, self.longest(text, 0)
        while True:
            end = at + len(self.bytes_of[token])
            if open_[end] and (not out or self.seams.holds(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = self.longest(text, at)
            elif (less := self.next_shorter(token)) is not None:
                token = less
            else:
                open_[at] = 0
                token = out.pop()
                at -= len(self.bytes_of[token])

    def encode(self, text: str) -> list[int]:
        pieces, cache = self.find(text), self.cache
        try:
            return list(chain.from_iterable(map(cache.__getitem__, pieces)))
        except KeyError:
            pass
        if len(cache) > CACHE_PIECES:
            cache.clear()
        out: list[int] = []
        for p in pieces:
            if (ids := cache.get(p)) is None:
                ids = tuple(self.encode_piece(p.encode("utf-8")))
                if len(p) <= CACHE_LENGTH:
                    cache[p] = ids
            out += ids
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[tuple[str, str], BytePairCodec] = {}


def codec(path: str, pattern: str | None = None) -> BytePairCodec:
    """One codec for each worker process and vocabulary."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = BytePairCodec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """``doc_id, ids array<int>, decoded binary``; or with ``digests`` what the ids and bytes hash to.

    Null and empty texts have no ids and decode to no bytes. Rows are independent:
    repeated ones repeat, an empty table stays empty, further columns are not read.
    A text that isn't valid UTF-8 cannot occur in a string column read by Spark's
    Python side; nothing is replaced.
    """
    path = path or default_path()
    base = docs.select(F.col(quoted(id_col)).alias("doc_id"), text_of(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches):
        c = codec(path)
        names = [str(i) for i in range(max(c.bytes_of) + 1)]
        for b in batches:
            n, ids_out, back = [], [], []
            for x in texts(b.column("text")):
                ids = c.encode(x)
                raw = c.decode(ids)
                n.append(len(ids))
                if digests:
                    ids_out.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(raw).hexdigest())
                else:
                    ids_out.append(ids)
                    back.append(raw)
            if digests:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_out, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids_out, pa.list_(pa.int32())), pa.array(back, pa.binary())], names=["doc_id", "ids", "decoded"])

    return base.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else f"doc_id {kind}, ids array<int>, decoded binary")
