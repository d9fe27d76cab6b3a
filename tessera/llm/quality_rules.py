"""Quality rules by weak supervision.

Rules look at a text's counts and vote +1 (sound), -1 (unsound) or 0 (abstain).
No rule decides alone: expectation-maximisation over the votes of all documents
estimates how often each rule is right on sound and on unsound texts when it votes
and how many are sound, and a document stays if its posterior probability of being sound is at
least one half. A vote pattern is one of 3**9, so EM runs on a histogram of that
bounded size, whatever the corpus.

Independent of the votes, a text fails outright (``base_failed``) with fewer than
20 words, or with over 30 % of its words in repeated 8-word windows.

Null and empty texts have zero counts and fail; a text of any length is judged
whole, in memory of a few numbers a word; repeated rows are judged alike;
an empty table gives an empty frame and a model with the prior accuracies.
Further columns pass through ``keep_sound`` untouched, whatever their names.
"""

from __future__ import annotations

import re
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import OWN, quoted, shielded, staged, text_of, unshielded

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_letters", "n_upper", "n_function", "n_echo")
WINDOW = 8
_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_CAPITALS = re.compile("[A-ZÀ-ÖØ-Þ]")
_LETTERS = re.compile("[^\\W\\d_]")
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    b"the of and to in is that it for was on with as be by this are or from at an not"
    b" der die das und zu den ist nicht mit von ein eine auf im dem des sich"
    b" le la les de et un une du en que qui dans pour par sur au pas"
    b" el los las que y por con para una del se no es su al lo".split()
)


def repeated_words(codes: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of that many words found twice or more."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    # names of spans of 1, 2, 4, 8 words: equal spans get equal numbers
    names, width = codes, 1
    while width < window:
        m = len(names) - width
        _, names = np.unique(names[:m].astype(np.int64) * (int(names.max()) + 1) + names[width:], return_inverse=True)
        if int(names.max()) + 1 == len(names):
            return 0  # all spans differ already
        width *= 2
    often = np.bincount(names)[names] > 1
    edge = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(often)
    edge[at] += 1
    np.subtract.at(edge, at + window, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts(text: str) -> tuple[int, ...]:
    """BASE and MORE counts of one text. Words are runs without ASCII white space."""
    words = text.encode("utf-8").split()
    n = len(words)
    if not n:
        return (0, 0, sum(map(text.count, _SYMBOLS)), 0, 0, 0, 0, 0, 0, 0)
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    repeats = repeated_words(np.fromiter(map(number.__getitem__, words), np.int64, n)) if n > WINDOW and len(number) < n else 0
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    plain = text.isascii()
    upper = len(_CAPITALS.findall(text))
    function = sum(map(FUNCTION_WORDS.__contains__, map(bytes.lower, words)))
    letters = len(text) - sum(map(text.count, _SPACE)) if plain and text.isalpha() else len(_LETTERS.findall(text))
    return (n, len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines), letters, upper, function, sum(map(eq, words, words[1:])))


def vote_columns() -> list:
    """The rules, each a column of +1, -1 or 0 over the counts."""
    f = {c: F.col(OWN + c).cast("double") for c in BASE + MORE}
    share = lambda a, b: f[a] / F.greatest(f[b], F.lit(1.0))

    def vote(value, good, bad):
        return F.when(bad(value), -1).when(good(value), 1).otherwise(0)

    return [
        vote(f["n_words"], lambda x: x >= 30, lambda x: x < 20),
        vote(share("word_chars", "n_words"), lambda x: x.between(3, 10), lambda x: (x < 2.2) | (x > 14)),
        vote(share("n_symbols", "n_words"), lambda x: x < 0.03, lambda x: x > 0.1),
        # of fewer than ten lines, a share says little
        vote(f["n_dup_lines"] / F.greatest(f["n_lines"], F.lit(10.0)), lambda x: x < 0.1, lambda x: x > 0.3),
        vote(share("n_repeat_words", "n_words"), lambda x: x < 0.1, lambda x: x > 0.3),
        vote(share("n_upper", "n_letters"), lambda x: x < 0.12, lambda x: x > 0.3),
        vote(share("n_function", "n_words"), lambda x: x > 0.12, lambda x: x < 0.03),
        vote(share("n_letters", "word_chars"), lambda x: x > 0.88, lambda x: x < 0.6),
        vote(share("n_echo", "n_words"), lambda x: x < 0.05, lambda x: x > 0.2),
    ]


RULES = 9
#: Votes that each rule is taken to have had on texts of either truth before any data.
PRIOR_VOTES = 10.0


class VoteModel:
    """Accuracies of the rules and the share of sound texts, from a histogram of vote patterns.

    Of a text of truth ``y`` (1: sound) rule ``j`` abstains at a rate that doesn't
    depend on ``y``, and otherwise votes for the truth with probability
    ``accuracy[y, j]``, all rules independently. EM maximises the likelihood of the
    votes times a prior of PRIOR_VOTES votes a rule and truth, four in five of them
    right, under the bound that no rule is worse than chance (``accuracy[0, j] +
    accuracy[1, j] >= 1``; where the free optimum breaks it, the optimum under it is
    the common rate of both truths). It starts from the share of votes against a
    text. ``posterior`` is Bayes' rule in this model; an abstention cancels out of it.
    """

    def __init__(self, patterns: np.ndarray, n: np.ndarray, rounds: int = 500):
        self.accuracy = np.full((2, RULES), 0.8)
        self.prior = 0.8
        if not len(n):
            return
        patterns, n = patterns.astype(int), n.astype(float)
        against = (patterns < 0).sum(1)
        p = np.where(against == 0, 0.98, np.where(against == 1, 0.4, 0.02))
        for _ in range(rounds):
            self.maximise(patterns, n, p)
            before, p = p, self.posterior(patterns)
            if abs(p - before).max() < 1e-9:
                break

    def maximise(self, patterns: np.ndarray, n: np.ndarray, p: np.ndarray) -> None:
        self.prior = float((p @ n + 0.8 * PRIOR_VOTES) / (n.sum() + PRIOR_VOTES))
        right = np.stack([((1 - p) * n) @ (patterns < 0), (p * n) @ (patterns > 0)]) + 0.8 * PRIOR_VOTES
        wrong = np.stack([((1 - p) * n) @ (patterns > 0), (p * n) @ (patterns < 0)]) + 0.2 * PRIOR_VOTES
        self.accuracy = right / (right + wrong)
        common = (right[1] + wrong[0]) / (right + wrong).sum(0)  # how often the rule votes "sound" at all
        worse = self.accuracy.sum(0) < 1
        self.accuracy[:, worse] = np.stack([1 - common, common])[:, worse]

    def log_likelihood(self, patterns: np.ndarray, n: np.ndarray) -> float:
        """What EM never lowers: the votes' log-likelihood, abstentions given, and the prior's."""
        start, w = self.weights()
        a = np.log(self.accuracy)
        unsound = np.log(1 - self.prior) + np.where(patterns < 0, a[0], np.where(patterns > 0, np.log1p(-self.accuracy[0]), 0)).sum(1)
        odds = start + w[np.arange(RULES), patterns.astype(int) + 1].sum(1)
        prior = PRIOR_VOTES * (0.8 * a + 0.2 * np.log1p(-self.accuracy)).sum() + PRIOR_VOTES * (0.8 * np.log(self.prior) + 0.2 * np.log(1 - self.prior))
        return float(n @ (unsound + np.logaddexp(0, odds)) + prior)

    def weights(self) -> tuple[float, np.ndarray]:
        """Log-odds of the prior, and what each rule's votes -1, 0, +1 add."""
        unsound, sound = self.accuracy
        return float(np.log(self.prior / (1 - self.prior))), np.stack([np.log((1 - sound) / unsound), np.zeros(RULES), np.log(sound / (1 - unsound))], axis=1)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        start, w = self.weights()
        return 1 / (1 + np.exp(-np.clip(start + w[np.arange(RULES), patterns.astype(int) + 1].sum(1), -500, 500)))


def counted(docs: DataFrame, text_col: str, keep_text: bool = True) -> DataFrame:
    """The rows, on demand without their text, with their counts and votes in own columns, staged."""
    names = [OWN + c for c in BASE + MORE]

    @F.pandas_udf(", ".join(f"{c} long" for c in names))
    def of(text):
        import pandas as pd

        return pd.DataFrame(np.array([counts(x) for x in text], np.int64).reshape(-1, len(names)), columns=names)

    at = OWN + "counts"
    rows = docs.withColumn(at, of(text_of(text_col)))
    rows = staged(rows if keep_text else rows.drop(text_col), "counted")
    rows = rows.select("*", *[F.col(f"{at}.{c}").alias(c) for c in names]).drop(at)
    return rows.withColumn(OWN + "votes", F.array(*[v.cast("tinyint") for v in vote_columns()]))


def judged(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> tuple[DataFrame, VoteModel]:
    """The rows with ``base_failed``, posterior and verdict in own columns, and the fitted model."""
    rows = counted(docs, text_col, keep_text)
    seen = rows.groupBy(OWN + "votes").agg(F.count("*").alias("n")).collect()  # at most 3**9 rows
    model = VoteModel(np.array([r[0] for r in seen], float).reshape(-1, RULES), np.array([r[1] for r in seen], float))
    start, weights = model.weights()
    odds = sum((F.when(F.col(OWN + "votes")[i] < 0, float(w[0])).when(F.col(OWN + "votes")[i] > 0, float(w[2])).otherwise(float(w[1])) for i, w in enumerate(weights)), F.lit(start))
    words, repeats = F.col(OWN + "n_words"), F.col(OWN + "n_repeat_words")
    rows = rows.withColumn(OWN + "failed", (words < 20) | (100 * repeats > 30 * words)).withColumn(OWN + "sound", 1 / (1 + F.exp(-odds)))
    return rows.withColumn(OWN + "kept", ~F.col(OWN + "failed") & (F.col(OWN + "sound") >= 0.5)), model


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``sound_probability`` and ``kept`` for each row."""
    rows, _ = judged(docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text")), "text", keep_text=False)
    return rows.select("doc_id", *[F.col(OWN + c).alias(c) for c in BASE], F.col(OWN + "failed").alias("base_failed"), F.col(OWN + "sound").alias("sound_probability"), F.col(OWN + "kept").alias("kept"))


def keep_sound(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with the columns they came with."""
    docs, now = shielded(docs)
    rows, _ = judged(docs, now[text_col])
    return rows.where(F.col(OWN + "kept")).select(*unshielded(now))
