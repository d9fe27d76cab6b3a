"""Text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words left out of the index, number words, patterns and limits decide results and must be these.
#: Words of number and quantity (two, one, all, any, more, most, same, only, other) are kept on purpose.
STOPWORDS = (
    "a an the and or but if then of for to in on at by with from as is are was were be been being it its this that these those you your we our they them their "
    "i me my have has had do does did so not no yes than into out up down over under may can will would should could given return such each some"
).split()
NUMBER_WORDS = {"1": "one", "2": "two", "3": "three", "4": "four"}
BLOCK_PAGE_MARKERS = ("just a moment", "enable javascript and cookies", "cloudflare", "attention required")
PAGE_MARKERS = ("Input", "Output", "Constraints", "Example")
MIN_USABLE, MAX_PAGE = 40, 6000
SLUG, PROBLEM_ID, HANDLE, EMAIL = "^[a-z0-9]+(-[a-z0-9]+)*$", "^[a-z0-9-]{3,128}$", "^[A-Za-z0-9_.-]{1,64}$", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
SEARCH_ID = "(?i)^[a-f0-9-]{8,40}$"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenize(text, stopwords=STOPWORDS) -> Column:
    """Lower-case runs of a-z and 0-9 in order, duplicates kept, stopwords dropped; null gives an empty array."""
    parts = F.split(F.lower(F.coalesce(col(text), F.lit(""))), "[^a-z0-9]+")
    return F.filter(parts, lambda t: (t != "") & ~t.isin(*stopwords) if stopwords else t != "")


def normalize_numbers(tokens) -> Column:
    """The tokens 1 to 4 as words."""
    pairs = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    return F.transform(col(tokens), lambda t: F.coalesce(F.try_element_at(pairs, t), t))


def indexed_text(title, body, tags=None, patterns=None) -> Column:
    """What the index sees of a record."""
    lists = [F.array_join(col(c), " ") for c in (tags, patterns) if c is not None]
    return F.concat_ws(" ", col(title), col(body), *lists)


def slugify(text) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def is_slug(x) -> Column:
    return F.coalesce(col(x).rlike(SLUG), F.lit(False))


def is_problem_id(x) -> Column:
    return F.coalesce(col(x).rlike(PROBLEM_ID), F.lit(False))


def is_handle(x) -> Column:
    return F.coalesce(col(x).rlike(HANDLE), F.lit(False))


def is_email(x) -> Column:
    return F.coalesce(col(x).rlike(EMAIL), F.lit(False))


def is_search_id(x) -> Column:
    return F.coalesce(col(x).rlike(SEARCH_ID), F.lit(False))


_WHITE = r"(?U)\s+"  # Unicode white space, non-breaking spaces too


def unescaped(text, closed: bool = False) -> Column:
    """Character references resolved, all named ones of HTML 5 too, as a parser and then a second look do; Arrow batches.

    ``closed``: only those that a semicolon ends; a parser takes old names without one, too.
    """

    @F.pandas_udf("string")
    def run(x):
        import re
        from html import unescape
        from html.entities import html5

        ended = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
        known = lambda m: unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0]
        one = (lambda v: ended.sub(known, v)) if closed else unescape
        return x.map(lambda v: one(one(v)) if v and "&" in v else v)

    return run(col(text))


def html_to_text(html, closed: bool = False) -> Column:
    """Visible text on one line: no scripts, styles, comments or tags, each of which ends a word; references resolved; white space single.

    ``closed``: only references that a semicolon ends are resolved.
    """
    x = F.regexp_replace(F.coalesce(col(html), F.lit("")), r"(?is)<(script|style)\b.*?(</\1\s*>|$)|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"""<[a-zA-Z/!?](?:"[^"]*"|'[^']*'|[^>"'])*>""", " ")
    return F.regexp_replace(F.regexp_replace(unescaped(x, closed), _WHITE, " "), "^ | $", "")


def trim_page(html, limit=MAX_PAGE, closed: bool = False) -> Column:
    """A problem page's text: `` # Input `` and the other three markers become `` Input: ``, and the page is cut."""
    x = html_to_text(html, closed)
    for m in PAGE_MARKERS:
        x = F.replace(x, F.lit(f" # {m} "), F.lit(f" {m}: "))
    return F.substring(x, 1, limit)


def has_usable_text(text) -> Column:
    x = F.lower(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?U)^\s+|\s+$", ""))
    return (F.length(x) >= MIN_USABLE) & ~x.rlike("|".join(BLOCK_PAGE_MARKERS))


def fallback_summary(text, title, topic, limit=500) -> Column:
    """The text's start, or a sentence made of title and topic."""
    return F.coalesce(F.nullif(F.substring(F.trim(F.coalesce(col(text), F.lit(""))), 1, limit), F.lit("")), F.concat(col(title), F.lit(" from "), col(topic), F.lit(".")))


def canonical_label(label, aliases: dict[str, str] | None = None) -> Column:
    slug = slugify(label)
    if not aliases:
        return slug
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(table, slug), slug)


def clean_labels(labels, aliases=None, cap=12) -> Column:
    """Canonical labels, first of each kept, at most ``cap``."""
    out = F.transform(F.coalesce(col(labels), F.array()), lambda x: canonical_label(x, aliases))
    return F.slice(F.array_distinct(F.filter(out, lambda x: x.isNotNull() & (x != ""))), 1, cap)


#: Rules from a label to the family it implies, in order. Fixed values.
FAMILY_RULES = [
    (r"(^|-)dp($|-)|dynamic-programming|memoi[sz]ation", "dynamic-programming"),
    (r"(^|-)bfs($|-)|breadth-first", "bfs"),
    (r"(^|-)dfs($|-)|depth-first", "dfs"),
    (r"binary-search", "binary-search"),
    (r"(^|-)(segment-tree|fenwick-tree)($|-)", "segment-tree"),
    (r"two-pointer", "two-pointers"),
    (r"stars-and-bars|binomial|permutation-counting|combination-counting|catalan|pigeonhole|inclusion-exclusion|counting-ways", "combinatorics"),
    (r"(^|-)(gcd|lcm)($|-)|divisor|(^|-)primes?($|-)|prime-|sieve|modular|modulo|totient|coprime|factorization|euclid", "number-theory"),
    (r"disjoint-set|(^|-)dsu($|-)", "union-find"),
]


def with_families(labels, rules: list[tuple[str, str]] = FAMILY_RULES, cap=12) -> Column:
    """Append the family of each label that matches a rule, in order of label, then rule."""
    families = F.flatten(F.transform(col(labels), lambda x: F.filter(F.array(*[F.when(x.rlike(p), F.lit(f)) for p, f in rules]), lambda y: y.isNotNull())))
    return F.slice(F.array_union(col(labels), families), 1, cap)


def unit_interval(value) -> Column:
    """A number clamped to [0, 1]; null if it isn't one (``least`` would pass over a null)."""
    x = col(value).try_cast("double")
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def clean_confidence(confidences, aliases=None) -> Column:
    """A map with canonical keys and numbers within [0, 1], the largest where keys meet; other values go."""
    entries = F.transform(F.map_entries(col(confidences)), lambda e: F.struct(canonical_label(e["key"], aliases).alias("k"), unit_interval(e["value"]).alias("v")))
    entries = F.filter(entries, lambda e: e["v"].isNotNull() & (e["k"] != ""))
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_max(F.transform(F.filter(entries, lambda e: e["k"] == k), lambda e: e["v"]))))


def host(url) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1)), r"^(www|m)\.", "")


def path_id(url) -> Column:
    """The last number in the path."""
    path = F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.regexp_extract(path, r"([0-9]+)(?:\.[a-z]+)?/?$", 1).try_cast("bigint")


def normal_url(url) -> Column:
    """Scheme, query, fragment, trailing slash and common host prefixes taken away."""
    path = F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.concat(host(url), F.regexp_replace(path, "/+$", ""))


def platform(url) -> Column:
    """The judge a URL belongs to by its host, else the host."""
    h = F.lower(F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    out = F.replace(h, F.lit("www."), F.lit(""))
    for part, name in reversed((("leetcode.com", "leetcode"), ("codeforces.com", "codeforces"), ("cses.fi", "cses"), ("atcoder.jp", "atcoder"))):
        out = F.when(h.contains(part), name).otherwise(out)
    return out


def problem_id(url) -> Column:
    """The record's id that a problem URL of one of the four judges stands for; null for other URLs."""
    u, p = col(url), platform(url)
    part = lambda pattern, group=1: F.nullif(F.regexp_extract(u, pattern, group), F.lit(""))
    contest = r"/(?:problemset/problem/|contest/(?=\d+/problem/))(\d+)/(?:problem/)?([A-Za-z0-9]+)"
    return (F.when(p == "leetcode", F.concat(F.lit("leetcode-"), part(r"/problems/([^/?#]+)")))
            .when(p == "cses", F.concat(F.lit("cses-"), part(r"/task/(\d+)")))
            .when(p == "codeforces", F.concat(F.lit("codeforces-"), part(contest).cast("decimal(38,0)").cast("string"), F.lit("-"), F.lower(part(contest, 2))))
            .when(p == "atcoder", F.concat(F.lit("atcoder-"), F.replace(F.lower(part(r"/tasks/([A-Za-z0-9_]+)")), F.lit("_"), F.lit("-")))))


def whole_between(value, low, high) -> Column:
    """A whole number within bounds, else null."""
    x = col(value).try_cast("double")
    return F.when((x == F.floor(x)) & x.between(low, high), x.cast("bigint"))


def count_in_sentence(text) -> Column:
    """The number that a sentence starts with; one that starts with "No" is 0, any other null."""
    return F.when(col(text).startswith("No"), F.lit(0)).otherwise(F.nullif(F.regexp_extract(col(text), "^([0-9]+) item", 1), F.lit("")).try_cast("int"))


def numbers_after(text, label: str) -> Column:
    """All whole numbers that stand behind a label and a colon, in order, as a page shows a rating or a count."""
    return F.transform(F.regexp_extract_all(col(text), F.lit(label + r"\s*:?\s*(?:<[^>]*>\s*)*([0-9]+)"), F.lit(1)), lambda x: x.try_cast("long"))


def day_levels(text) -> Column:
    """A calendar's cells as a map of day to level: elements with a ``data-date`` and, anywhere in the same tag, a ``data-level``; the last of equal days counts."""
    tags = F.regexp_extract_all(col(text), F.lit(r"(<[^<>]*data-date=[^<>]*data-level=[^<>]*>|<[^<>]*data-level=[^<>]*data-date=[^<>]*>)"), F.lit(1))
    cells = F.transform(tags, lambda x: F.struct(F.regexp_extract(x, r'data-date="([0-9-]+)"', 1).alias("day"), F.regexp_extract(x, r'data-level="([0-9]+)"', 1).try_cast("long").alias("level")))
    days = F.array_distinct(F.transform(cells, lambda c: c["day"]))
    return F.map_from_arrays(days, F.transform(days, lambda d: F.element_at(F.filter(cells, lambda c: c["day"] == d), -1)["level"]))


def day_bucket(seconds) -> Column:
    """The second at which the UTC day began."""
    return (F.floor(col(seconds) / 86400) * 86400).cast("bigint")


def stripped(text) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(col(text), r"^\s+|\s+$", "")


def clip(text, n) -> Column:
    return F.substring(col(text), 1, n)


def snap(value, step, up=False) -> Column:
    return (F.ceil if up else F.floor)(col(value) / step) * step


def angle_degrees(cosine) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), col(cosine)))))


def document_digest(doc_id, text) -> Column:
    """Digest of a record; ``fingerprint`` of the operators combines them."""
    return F.sha2(F.concat(col(doc_id).cast("string"), F.lit("\n"), col(text), F.lit("\n")), 256)


def osa_distance(a, b) -> Column:
    """Edit distance with swaps of neighbours (optimal string alignment), as one expression.

    The fold keeps the last two rows of the table, in one array each; no Python runs.
    """
    a, b = col(a), col(b)
    m = F.length(b)
    row0 = F.sequence(F.lit(0), m)

    def step(acc, i):
        before, prev = acc["before"], acc["prev"]
        ca = F.substr(a, i, F.lit(1))

        def cell(row, j):
            cb = F.substr(b, j, F.lit(1))
            cost = F.when(ca == cb, 0).otherwise(1)
            best = F.least(F.element_at(row, -1) + 1, F.element_at(prev, j + 1) + 1, F.element_at(prev, j) + cost)
            swap = (i > 1) & (j > 1) & (ca == F.substr(b, F.greatest(j - 1, F.lit(1)), F.lit(1))) & (F.substr(a, F.greatest(i - 1, F.lit(1)), F.lit(1)) == cb)
            swapped = F.when(swap, F.element_at(before, F.greatest(j - 1, F.lit(1))) + 1).otherwise(best)
            return F.concat(row, F.array(F.least(best, swapped)))

        js = F.filter(F.sequence(F.lit(0), m), lambda j: j > 0)
        return F.struct(prev.alias("before"), F.aggregate(js, F.array(i), cell).alias("prev"))

    start = F.struct(row0.alias("before"), row0.alias("prev"))
    is_ = F.filter(F.sequence(F.lit(0), F.length(a)), lambda i: i > 0)
    return F.element_at(F.aggregate(is_, start, step)["prev"], -1)


SEALED = "v1:"


def seal(text, key: Column) -> Column:
    """Encrypt with AES-GCM; values that are sealed already stay."""
    x = col(text)
    return F.when(x.startswith(SEALED), x).otherwise(F.concat(F.lit(SEALED), F.base64(F.aes_encrypt(x, key, F.lit("GCM")))))


def unseal(text, key: Column) -> Column:
    """Decrypt what is sealed, pass on what isn't; null where the key doesn't fit."""
    x = col(text)
    return F.when(x.startswith(SEALED), F.try_aes_decrypt(F.unbase64(F.substring(x, len(SEALED) + 1, 1 << 30)), key, F.lit("GCM")).cast("string")).otherwise(x)
