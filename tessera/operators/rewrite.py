"""Query rewriting: alias expansion, spelling correction, vocabulary guard."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from .common import bounded_broadcast, ranked, spread

MAX_QUERY, MAX_ADDED = 300, 8
MIN_TERM, MIN_DF, MAX_CORRECTIONS = 3, 3, 2


@dataclass(frozen=True)
class Alias:
    alias: str
    canonical: str
    consuming: bool = False


@dataclass
class Expansion:
    query: str
    expanded: bool = False
    added: list[str] = field(default_factory=list)
    matches: list[str] = field(default_factory=list)


class AliasTrie:
    """All aliases in one trie over characters, with one edge for white space and hyphens between words.

    From each place where a word may begin a text is followed down the trie, so that
    the aliases it holds are found together, in time linear in the text for aliases of bounded length.
    """

    END, GAP = "end", "gap"

    def __init__(self, aliases: list[list[str]]):
        """``aliases``: the words of each; what is found is told by its place in the list."""
        self.root: dict = {}
        for i, words in enumerate(aliases):
            at = self.root
            for k, word in enumerate(words):
                if k:
                    at = at.setdefault(self.GAP, {})
                for c in word:
                    at = at.setdefault(c, {})
            at.setdefault(self.END, []).append(i)

    @staticmethod
    def _inner(c: str) -> bool:
        """Whether a letter or digit: beside one no alias begins or ends. A fixed value, it decides results."""
        return "a" <= c <= "z" or "0" <= c <= "9"

    def found(self, text: str) -> dict[int, tuple[int, int]]:
        """The aliases in a lower-cased text, each with its first place: where it begins, with the sign before it, and ends."""
        out: dict[int, tuple[int, int]] = {}
        n = len(text)
        for start in range(n):
            if start and self._inner(text[start - 1]):
                continue
            at, i = self.root, start
            while i < n:
                c = text[i]
                if c == "-" or c.isspace():
                    at = at.get(self.GAP)
                    while at is not None and i < n and (text[i] == "-" or text[i].isspace()):
                        i += 1
                else:
                    at = at.get(c)
                    i += 1
                if at is None:
                    break
                if self.END in at and not (i < n and self._inner(text[i])):
                    for k in at[self.END]:
                        out.setdefault(k, (max(start - 1, 0), i))
        return out


class Expander:
    """Alias rules, longest canonical first, then longest alias.

    Consuming aliases of several words blank their first occurrence and stand for
    their canonical words; all others only append the canonical words that aren't
    there. What counts as there is what consumption left. A query gains at most
    eight words; numbers 1 to 4 that stand alone gain their word. ``matches`` names
    every rule that fired, also one whose words were all there. A query that gains
    nothing is returned as it came.
    """

    def __init__(self, rules: list[Alias]):
        self.rules = [r for r in sorted(rules, key=lambda r: (-len(self._words(r.canonical)), -len(r.alias))) if self._words(r.alias)]
        self.words = [self._words(r.canonical) for r in self.rules]
        self.consumes = [r.consuming and len(self._words(r.alias)) > 1 for r in self.rules]
        self.trie = AliasTrie([self._words(r.alias) for r in self.rules])

    @staticmethod
    def _words(slug: str) -> list[str]:
        return [w for w in re.split(r"[\s-]+", slug.lower()) if w]

    def expand(self, query: str | None) -> Expansion:
        if not isinstance(query, str) or not query.strip() or len(query) > MAX_QUERY:
            return Expansion(query)
        left, matches, queued = query.lower(), [], []
        found, last = self.trie.found(left), -1
        # in order of the rules; a blank may bring words together or take a match away, so the text is walked again
        while (rule := min((i for i in found if i > last and self.consumes[i]), default=None)) is not None:
            a, b = found[rule]
            left = left[:a] + " " * (b - a) + left[b:]
            queued += self.words[rule]
            matches.append(self.rules[rule].alias)
            found, last = self.trie.found(left), rule
        tokens = re.findall("[a-z0-9]+", left)
        gained: dict[str, None] = {}  # in order

        def gain(words: list[str]) -> bool:
            new = [w for w in dict.fromkeys(words) if w not in gained and w not in tokens][: MAX_ADDED - len(gained)]
            gained.update(dict.fromkeys(new))
            return bool(new)

        gain(queued)
        for rule in sorted(i for i in found if not self.consumes[i]):
            if len(gained) >= MAX_ADDED:
                break
            matches.append(self.rules[rule].alias)
            gain(self.words[rule])
        matches += [t for t in tokens if t in T.NUMBER_WORDS and gain([T.NUMBER_WORDS[t]])]
        if not gained:
            return Expansion(query, matches=matches)
        return Expansion(" ".join([*left.split(), *gained]), True, list(gained), matches)


def expand(queries: DataFrame, rules: list[Alias]) -> DataFrame:
    """``qid, query`` to ``qid, query, expanded, added, matches``, in Arrow batches.

    The trie of the rules, a table kept by hand, is sent to each executor once.
    """
    sent = queries.sparkSession.sparkContext.broadcast(Expander(rules))

    @F.pandas_udf("query string, expanded boolean, added array<string>, matches array<string>")
    def run(q):
        import pandas as pd

        out = [sent.value.expand(x) for x in q]
        return pd.DataFrame({"query": [x.query for x in out], "expanded": [x.expanded for x in out], "added": [x.added for x in out], "matches": [x.matches for x in out]})

    return queries.select("qid", run("query").alias("x")).select("qid", "x.*")


def _without(words: Column, i: Column) -> Column:
    """The word without its ``i``-th letter."""
    return F.concat(F.substr(words, F.lit(1), i - 1), F.substr(words, i + 1, F.lit(1 << 20)))


def deletions(word: Column, most: Column) -> Column:
    """The word itself and what is left of it without any one letter, or any two if ``most`` is 2."""
    places = lambda x: F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1)))
    once = F.array_distinct(F.transform(places(word), lambda i: _without(word, i)))
    twice = F.when(most >= 2, F.flatten(F.transform(once, lambda x: F.transform(places(x), lambda i: _without(x, i))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), once, twice))


def corrections(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``qid, pos, term, correction, distance`` for unknown words.

    Candidates have at least MIN_DF documents, a length within the word's budget
    of edits and its first or its last letter; nearest first, then most frequent,
    then alphabetical. At most two words of a query are corrected. Two words within
    n edits, swaps among them, leave a common rest when n letters are taken out of
    either, so candidates come from an equality join on such rests.
    """
    # joined with the counts, though only absence is asked: so this and the targets below read one vocabulary
    unknown = tokens.where(F.length("term") >= MIN_TERM).join(vocabulary.select("term", "df"), "term", "left").where("df IS NULL")
    unknown = unknown.groupBy("qid", "term").agg(F.min("pos").alias("pos"))
    words = unknown.select("term").distinct().withColumn("budget", F.when(F.length("term") >= 8, 2).otherwise(1))
    rests = bounded_broadcast(words.select("term", "budget", F.explode(deletions(F.col("term"), F.col("budget"))).alias("rest")))
    targets = vocabulary.where(F.col("df") >= MIN_DF).select(F.col("term").alias("correction"), "df")
    # words of eight letters may lose two, so their targets have six at least
    targets = spread(targets).select("correction", "df", F.explode(deletions(F.col("correction"), F.when(F.length("correction") >= 6, 2).otherwise(1))).alias("rest"))
    ends = (F.substring("term", 1, 1) == F.substring("correction", 1, 1)) | (F.substring("term", -1, 1) == F.substring("correction", -1, 1))
    pairs = targets.join(rests, "rest").where((F.abs(F.length("term") - F.length("correction")) <= F.col("budget")) & ends)
    pairs = pairs.select("term", "budget", "correction", "df").distinct().withColumn("distance", T.osa_distance("term", "correction")).where("distance <= budget")
    best = ranked(pairs, ["term"], [F.col("distance"), F.col("df").desc(), F.col("correction")], 1).drop("rank")
    return ranked(unknown.join(best, "term"), ["qid"], [F.col("pos")], MAX_CORRECTIONS).select("qid", "pos", "term", "correction", "distance")


def apply_corrections(queries: DataFrame, fixes: DataFrame) -> DataFrame:
    """Append the corrections to their queries, in the order of the terms they are for."""
    words = fixes.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "correction"))), lambda x: x["correction"]), " ").alias("more"))
    return queries.join(words, "qid", "left").withColumn("query", F.when(F.col("more").isNull(), F.col("query")).otherwise(F.concat_ws(" ", "query", "more"))).drop("more")


def guard(queries: DataFrame, tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``qid, refused, unknown_terms``: refused if there are tokens and none is known; the first five unknown ones."""
    marked = tokens.join(vocabulary.select("term", F.lit(True).alias("known")), "term", "left").groupBy("qid").agg(
        F.bool_and(F.col("known").isNull()).alias("refused"),
        F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.struct("pos", "term")))), lambda x: x["term"])), 1, 5).alias("unknown_terms"))
    return queries.select("qid").join(marked, "qid", "left").select("qid", F.coalesce("refused", F.lit(False)).alias("refused"), F.when(F.col("refused"), F.col("unknown_terms")).otherwise(F.array().cast("array<string>")).alias("unknown_terms"))
