"""Token counts by a compiled finite-state transducer.

The merges of the tokenizer are compiled into a deterministic transducer over 512
symbols: the 256 bytes, and the 256 bytes as the last of a piece. After a prefix,
BPE's encoding of it is that of a shorter prefix and one more token, the one whose
seam with the token before it merging would leave (see ``bpe.Seams``). So a state
has the place in the trie of tokens that the last bytes lead to and, for each of
their ends from which a token may go on, the token that ends there and how many
tokens fewer the encoding has up to there. A transition on a symbol carries the
tokens emitted: how many more the encoding of the longer prefix has, which can be
negative while a piece lasts. The last symbol of a piece leads back to the start.
There are finitely many states, since the trie bounds how far back they look; only
those that texts reach are ever determined, and a bounded number is remembered.

A piece's path from the start back to it is remembered as one composed transition.
Texts longer than CHUNK_CHARS are cut at white space, where the state is always the
start. A stretch without any is cut where no normalisation and no piece reaches
across: between a letter and a sign, say. What then is left are single pieces of
many thousand bytes. Such a piece is cut anywhere, and each chunk of it becomes a
*chunk map* from states to the state after it and the tokens emitted. A map is
worked out for the states that are asked of it; the first one is foreseen by running
the bytes just before the chunk, since what was read longer ago hardly ever shows in
the state. Maps compose associatively, so they are put together by a prefix scan of
logarithmic depth, and a chunk whose entry state was not foreseen is run again. Memory
is linear in the text: a map holds a few numbers and refers to its bytes.

White space, Unicode normalisation and the cut into pieces are the tokenizers
library's where a word isn't of plain Latin letters (see ``words``); special strings
are cut out before, and each counts as one token.

Defined results: null and empty texts have 0 bytes and 0 tokens; a special
string inside a text counts as the library counts it (one token); a text of any
length is counted whole, in chunks; repeated rows each give a row; an empty table
gives an empty frame; further columns of the input are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .bpe import Seams
from .common import quoted, text_of, texts

LIMIT = 2048
CHUNK_CHARS = 1 << 16
#: Composed transitions, and single ones, that a worker remembers before it starts afresh.
REMEMBERED, TRANSITIONS = 600_000, 2_000_000
END = 256
#: In a packed transition: the bits for the emission, and what is added so that it isn't negative.
_EMIT_BITS, _EMIT_ZERO = 8, 128


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update((chr(256 + i), b) for i, b in enumerate(sorted(set(range(256)) - set(plain))))
    return out


#: The state before a piece: the place in the trie, and for each end the token before and the tokens fewer.
START = (0, ((-1, 0),))


class MergeTransducer:
    """``run(symbols)``: the tokens that a piece becomes; states and transitions are determined when first reached."""

    def __init__(self, merges: list[tuple[str, str]], end_of_word: str):
        letters = byte_letters()
        numbers = {x: b for x, b in letters.items()} | {x + end_of_word: b + END for x, b in letters.items()}
        spelt: dict[int, tuple[int, ...]] = {s: (s,) for s in range(2 * END)}
        halves: dict[int, tuple[int, int]] = {}
        for i, (a, b) in enumerate(merges, 2 * END):
            if a + b in numbers:
                raise ValueError("two merges make one token")
            numbers[a + b] = i
            halves[i] = numbers[a], numbers[b]
            spelt[i] = spelt[numbers[a]] + spelt[numbers[b]]
        self.seams = Seams(halves)
        # the trie of tokens: children, the token that ends at a node, and the node of its longest proper end
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for t, symbols in spelt.items():
            if t in halves and not self._stands(t):
                continue
            at = 0
            for s in symbols:
                to = self.child[at].get(s)
                if to is None:
                    to = self.child[at][s] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                at = to
            self.token[at] = t
        self.shorter = [0] * len(self.child)
        todo = [0]
        for at in todo:
            for s, to in self.child[at].items():
                if at:
                    back = self.shorter[at]
                    while back and s not in self.child[back]:
                        back = self.shorter[back]
                    self.shorter[to] = self.child[back].get(s, 0)
                todo.append(to)
        self._ends: dict[int, tuple[int, ...]] = {}
        self._forget()

    def _stands(self, t: int) -> bool:
        """Whether merging a token's own symbols ends in that token: each seam inside it must give way to its merges."""
        a, b = self.seams.halves[t]
        return self._stood(a, b, t)

    def _stood(self, a: int, b: int, t: int) -> bool:
        # with the merge itself left out, the halves must stay side by side until it comes
        joined = self.seams.joined.pop((a, b))
        out = self.seams._holds(a, b)
        self.seams.joined[a, b] = joined
        return out

    def _forget(self) -> None:
        self.states: dict[tuple, int] = {START: 0}
        self.contents: list[tuple] = [START]
        self.steps: dict[int, int] = {}

    def ends(self, node: int) -> tuple[int, ...]:
        """The nodes of all ends of a node's symbols from which a token may go on, longest first, the root last."""
        if (known := self._ends.get(node)) is None:
            out, at = [], node
            while at:
                if self.child[at]:
                    out.append(at)
                at = self.shorter[at]
            known = self._ends[node] = (*out, 0)
        return known

    def determine(self, state: int, symbol: int) -> int:
        """The transition: next state and emission, packed."""
        node, before = self.contents[state]
        ends = self.ends(node)
        to_of = [self.child[at].get(symbol, -1) for at in ends]
        for to, (last, fewer) in zip(to_of, before):
            if to >= 0 and (t := self.token[to]) >= 0 and (last < 0 or self.seams.holds(last, t)):
                break
        else:
            raise ValueError("no token ends here")
        emitted = fewer + 1
        if symbol >= END:
            return emitted + _EMIT_ZERO
        # those of the old ends that the symbol extends and from which a token may still go on
        kept = [(to, (last, fewer - emitted)) for to, (last, fewer) in zip(to_of, before) if to >= 0 and self.child[to]]
        key = (kept[0][0] if kept else 0, (*(x for _, x in kept), (t, 0)))
        number = self.states.get(key)
        if number is None:
            number = self.states[key] = len(self.contents)
            self.contents.append(key)
        return number << _EMIT_BITS | emitted + _EMIT_ZERO

    def through(self, state: tuple, symbols: bytes) -> tuple[tuple, int]:
        """From a state, by its content, over bytes of which none ends the piece: the state then, and the tokens emitted."""
        total = 0
        for at in range(0, len(symbols), CHUNK_CHARS):
            if len(self.steps) > TRANSITIONS:
                self._forget()
            number, get = self.number(state), self.steps.get
            for s in symbols[at : at + CHUNK_CHARS]:
                step = get(number << 9 | s) or self._step(number, s)
                total += (step & 255) - _EMIT_ZERO
                number = step >> _EMIT_BITS
            state = self.contents[number]
        return state, total

    def run(self, symbols: bytes) -> int:
        """The tokens of one piece, given as bytes of which the last one ends it."""
        if len(self.steps) > TRANSITIONS:
            self._forget()
        get, state, total = self.steps.get, 0, 0
        for s in symbols[:-1]:
            step = get(state << 9 | s) or self._step(state, s)
            total += step & 255
            state = step >> _EMIT_BITS
        step = get(state << 9 | symbols[-1] + END) or self._step(state, symbols[-1] + END)
        return total + step - _EMIT_ZERO * len(symbols)

    def number(self, state: tuple) -> int:
        if state not in self.states:
            self.states[state] = len(self.contents)
            self.contents.append(state)
        return self.states[state]

    def _step(self, state: int, symbol: int) -> int:
        out = self.steps[state << 9 | symbol] = self.determine(state, symbol)
        return out


class ChunkMap:
    """What a stretch of a piece's bytes does to a state: (next state, tokens emitted) for the states asked for."""

    def __init__(self, transducer: MergeTransducer, symbols: bytes = b"", parts: tuple["ChunkMap", "ChunkMap"] | None = None):
        self.transducer, self.symbols, self.parts = transducer, symbols, parts
        self.known: dict[tuple, tuple[tuple, int]] = {}

    def after(self, state: tuple) -> tuple[tuple, int]:
        if (found := self.known.get(state)) is None:
            if self.parts is None:
                found = self.transducer.through(state, self.symbols)
            else:
                middle, n = self.parts[0].after(state)
                end, m = self.parts[1].after(middle)
                found = end, n + m
            self.known[state] = found
        return found

    def then(self, other: "ChunkMap") -> "ChunkMap":
        """The map of both stretches; for states that this one has been asked for it is worked out at once."""
        out = ChunkMap(self.transducer, parts=(self, other))
        for state in self.known:
            out.after(state)
        return out


#: Bytes before a chunk from which its entry state is foreseen.
FORESEEN = 256


def chunk_maps(transducer: MergeTransducer, symbols: bytes, chunk: int) -> list[ChunkMap]:
    """The maps of a piece's chunks, each worked out for the state it is foreseen to be entered in."""
    out = []
    for at in range(0, len(symbols), chunk):
        m = ChunkMap(transducer, symbols[at : at + chunk])
        m.after(transducer.through(START, symbols[max(0, at - FORESEEN) : at])[0])
        out.append(m)
    return out


def prefix_scan(maps: list[ChunkMap]) -> list[ChunkMap]:
    """All prefixes' maps, in log2(n) rounds whose compositions don't depend on each other."""
    step, maps = 1, list(maps)
    while step < len(maps):
        maps = [maps[i - step].then(m) if i >= step else m for i, m in enumerate(maps)]
        step *= 2
    return maps


#: Where the tokenizer's normalisation puts a space: the white space of its pattern. Fixed values.
WHITE = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Runs of which pieces are made: letters, single digits, other signs. Fixed values.
_RUNS = "\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+"


@cache
def joining() -> frozenset[str]:
    """The characters that normalisation may join to what stands before: second halves of compositions, and what begins with a mark or such a half."""
    seconds = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}  # of Hangul syllables
    apart = {}
    for c in range(0x110000):
        told = unicodedata.decomposition(chr(c))
        if told and told[0] != "<":
            apart[chr(c)] = unicodedata.normalize("NFD", chr(c))
            if " " in told:
                seconds.add(chr(int(told.split(" ")[1], 16)))
    return frozenset(seconds | {c for c, x in apart.items() if unicodedata.combining(x[0]) or x[0] in seconds})


def inert(c: str) -> bool:
    """Whether normalisation never joins anything across a cut before a character."""
    return c.isascii() or unicodedata.combining(c) == 0 and c not in joining()


class TokenCounter:
    """Counts the tokens of texts; remembers the composed transition of each piece."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        told = json.loads(self.library.to_str())
        self.special = [x["content"] for x in told["added_tokens"]]
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in told["model"]["merges"]]
        self.transducer = MergeTransducer(merges, told["model"]["end_of_word_suffix"])
        self.letters = byte_letters()
        self.emits: dict[str, int] = {}
        import regex

        self.runs = regex.compile(_RUNS).finditer
        self.digit = regex.compile("\\p{N}").match
        self.leading = {"letters": regex.compile("\\p{L}+").match, "signs": regex.compile("[^\\s\\p{L}\\p{N}]+").match}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda x: [x]

    def emission(self, unit: str) -> int:
        """From the start back to it: the tokens of a piece, or of a whole word behind a space (see ``words.units``)."""
        if unit[0] != " ":
            return self.transducer.run(unit.encode())
        word = unit[1:]
        if any(x in word for x in self.special):
            return len(self.library.encode(word, add_special_tokens=False).ids)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))
        return sum(self.transducer.run(bytes(map(self.letters.__getitem__, piece))) for piece, _ in found)

    def prepare(self, cut: list[list[str]]) -> None:
        new = set().union(*cut).difference(self.emits)
        if len(self.emits) + len(new) > REMEMBERED:
            self.emits.clear()
            new = set().union(*cut)
        self.emits.update((u, self.emission(u)) for u in new)

    def count(self, text: str) -> int:
        """Tokens of a stretch that white space bounds."""
        own = W.units(text)
        self.prepare([own])
        return sum(map(self.emits.__getitem__, own))

    def piece(self, symbols: bytes, chunk: int) -> int:
        """The tokens of a long piece, by the maps of its chunks."""
        last = ChunkMap(self.transducer, b"")
        maps = chunk_maps(self.transducer, symbols[:-1], chunk)
        state, n = (prefix_scan(maps)[-1] if maps else last).after(START)
        return n + self.transducer.determine(self.transducer.number(state), symbols[-1] + END) - _EMIT_ZERO

    def normalised(self, word: str, chunk: int):
        """The normalised parts of a stretch without white space, cut where nothing is joined across."""
        at = 0
        while at < len(word):
            to = min(at + chunk, len(word))
            while to < len(word) and not inert(word[to]):
                to += 1
            yield self.library.normalizer.normalize_str(word[at:to])
            at = to

    def word(self, word: str, chunk: int) -> int:
        """The tokens of a long stretch without white space: pieces are found in parts, and an unfinished piece goes on into the next part."""
        total, open_, held = 0, "", bytearray()  # ``held``: the bytes of an open piece of one kind of characters that is long already
        kind, much = None, max(chunk, 16)  # more than the longest short form
        for part in self.normalised(word, chunk):
            if held:
                m = self.same(kind)(part)
                held += part[: m.end()].encode() if m else b""
                if m and m.end() == len(part):
                    continue
                total += self.piece(bytes(held), chunk)
                held, part = bytearray(), part[m.end() if m else 0 :]
            open_ += part
            runs = [(m.start(), m.group()) for m in self.runs(open_)]
            if not runs:
                continue
            start, text = runs[-1]
            if len(runs) > 1 and runs[-2][1] == "'":  # may begin a short form with what follows
                start, text = runs[-2][0], "'" + text
            total += self.count_pieces(open_[:start])
            open_ = open_[start:]
            if len(open_) > much and text[0] == "'" and len(text) > 1 and self.kind_of(text[1]) == "letters":
                first = self.library.pre_tokenizer.pre_tokenize_str(open_[:16])[0][1][1]
                total += self.count_pieces(open_[:first])
                open_ = open_[first:]
            if len(open_) > much and self.kind_of(open_[0]) != "digit":
                kind, held, open_ = self.kind_of(open_[0]), bytearray(open_.encode()), ""
        return total + (self.piece(bytes(held), chunk) if held else self.count_pieces(open_))

    def kind_of(self, c: str) -> str:
        return "letters" if self.same("letters")(c) else "digit" if self.digit(c) else "signs"

    def same(self, kind: str):
        """Matches the characters of a kind at the beginning of a text."""
        return self.leading[kind]

    def count_pieces(self, text: str) -> int:
        """Of normalised text that pieces don't reach out of."""
        return sum(self.transducer.run(bytes(map(self.letters.__getitem__, piece))) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)) if text else 0

    def long(self, text: str, chunk: int) -> int:
        """The tokens of a text of any length, some ``chunk`` characters at a time."""
        total, at = 0, 0
        while at < len(text):
            to = min(at + chunk, len(text))
            if to < len(text):
                cut = next((i for i in range(to, at, -1) if WHITE.match(text, i - 1)), None)
                if cut is None:  # no white space in all of it: the stretch goes on to the next
                    m = WHITE.search(text, to)
                    to = m.start() if m else len(text)
                    parts = self.split_special(text[at:to])
                    total += len(parts) // 2 + sum(self.word(x, chunk) for x in parts[::2] if x)
                    at = to
                    continue
                to = cut
            total += self.count(text[at:to])
            at = to
        return total

    def tokens(self, many: list[str], chunk: int = 0) -> list[int]:
        chunk = chunk or CHUNK_CHARS
        short = [x if len(x) <= chunk else "" for x in many]
        out: list[int] = []
        for cut in W.in_groups(short):
            self.prepare(cut)
            get = self.emits.__getitem__
            out += [sum(map(get, own)) for own in cut]
        for i, x in enumerate(many):
            if len(x) > chunk:
                out[i] = self.long(x, chunk)
        return out


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row; no shuffle."""
    path = path or W.default_path()
    base = docs.select(F.col(quoted(id_col)).alias("doc_id"), text_of(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches):
        t = counter(path)
        for b in batches:
            own = texts(b.column("text"))
            n = t.tokens(own)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x.encode()) for x in own], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return base.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
