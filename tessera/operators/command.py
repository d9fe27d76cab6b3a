"""What a search box's text asks for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

# The commands and their short forms.
HELP = (":help", ":h")
COMPARE = (":compare", ":cmp")
LIBRARY = {":bookmarks": "bookmarked", ":b": "bookmarked", ":done": "done", ":d": "done", ":all": "all", ":library": "all", ":lib": "all", "ls bookmarks": "bookmarked", "ls done": "done"}


@dataclass(frozen=True)
class Command:
    """``kind``: search, compare, help, library, needs_account or unknown; ``argument``: the query, help section or view."""

    kind: str
    argument: str = ""


def parse_command(text: str | None, signed_in: bool = True) -> Command:
    """A library view, a comparison or help; text with a leading colon that is none of them is refused, not searched."""
    text = (text or "").strip()
    low = text.lower()
    word, _, rest = low.partition(" ")
    for kind, words in (("compare", COMPARE), ("help", HELP)):
        if word in words:
            return Command(kind, text[len(word) :].strip())
    if low in LIBRARY:
        return Command("library" if signed_in else "needs_account", LIBRARY[low])
    return Command("unknown" if text.startswith(":") else "search", text)


def commands(typed: DataFrame) -> DataFrame:
    """``kind, argument`` beside each row's ``text`` and ``signed_in``."""

    @F.pandas_udf("kind string, argument string")
    def run(text, signed_in):
        import pandas as pd

        out = [parse_command(a, bool(b)) for a, b in zip(text, signed_in)]
        return pd.DataFrame({"kind": [x.kind for x in out], "argument": [x.argument for x in out]})

    return typed.withColumn("_c", run("text", "signed_in")).select(*typed.columns, "_c.kind", "_c.argument")
