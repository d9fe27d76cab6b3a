"""The operators' own algorithms, without Spark, against brute force."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import bpe, huffman, importance, masked_lm, packing, quality_rules, sharding, simhash, token_count, words

ODD = ["", " ", "a" * 4000, "日本語 テキスト" * 40, "it's 12³ don't'll éa İx Σας <|endoftext|>x a\x1cb _b__ ª º µ ß ǆ ×", "a\tb\r\nc\x85d\xa0e f", "<|ENDOFTEXT|> <|startoftext|>" * 30, "\n\n x", "é ́x", "x" * 30 + " y" * 500, "😀 👩‍👩‍👧 z"]


def some_texts(n=200, seed=0):
    r = random.Random(seed)
    return ["".join(r.choice("eatin sro,.'!\n0É日<|>") for _ in range(r.randint(0, 300))) for _ in range(n)] + ODD


def test_words_equal_the_library():
    e = words.WordEncoder(words.default_path(), cache_pieces=300)  # forgets often
    for x, ids in zip(some_texts(), e.encode_many(some_texts())):
        assert e.ids(ids).tolist() == e.full.encode(x, add_special_tokens=False).ids


def test_counts_equal_the_library(monkeypatch):
    t = token_count.TokenCounter(words.default_path())
    want = [len(t.library.encode(x, add_special_tokens=False).ids) for x in some_texts()]
    assert t.tokens(some_texts()) == want and t.tokens(some_texts(), 7) == want
    monkeypatch.setattr(token_count, "TRANSITIONS", 50)
    monkeypatch.setattr(token_count, "REMEMBERED", 100)
    t = token_count.TokenCounter(words.default_path())
    assert t.tokens(some_texts()) == want  # forgetting changes nothing


def test_transducer_equals_merging_for_all_short_strings():
    from itertools import product

    merges = [("a", "b"), ("b", "a"), ("ab", "a"), ("b", "c</w>"), ("a", "a"), ("aa", "b"), ("a", "c</w>"), ("ba", "ba"), ("c", "ab"), ("aba", "bc</w>")]
    t = token_count.MergeTransducer(merges, "</w>")

    def merged(piece):
        parts = [*piece[:-1], piece[-1] + "</w>"]
        while True:
            found = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
            if not found:
                return len(parts)
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for n in range(1, 9):
        for piece in map("".join, product("abc", repeat=n)):
            assert t.run(piece.encode()) == merged(piece), piece
    assert len(t.contents) < 200


def test_chunk_maps_compose_through_states():
    t = token_count.TokenCounter(words.default_path())
    r = random.Random(3)
    for _ in range(60):
        text = "".join(r.choice(("etaoin", "abcdefghij", "xyzq", "a")[r.randint(0, 3)]) for _ in range(r.randint(2, 300))).encode()
        whole = t.transducer.through(token_count.START, text)
        cuts = sorted(r.randint(0, len(text)) for _ in range(r.randint(1, 9)))
        maps = [token_count.ChunkMap(t.transducer, text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])]
        assert token_count.prefix_scan(maps)[-1].after(token_count.START) == whole
        if len(maps) > 2:
            a, b, c = maps[:3]
            entries = [token_count.START, t.transducer.through(token_count.START, b"the")[0], t.transducer.through(token_count.START, b"internationa")[0]]
            for e in entries:
                assert a.then(b).then(c).after(e) == a.then(b.then(c)).after(e)
                step = e
                total = 0
                for m in (a, b, c):
                    step, n = m.after(step)
                    total += n
                assert a.then(b).then(c).after(e) == (step, total)
        for chunk in (1, 3, 64):
            foreseen = token_count.chunk_maps(t.transducer, text, chunk)
            assert token_count.prefix_scan(foreseen)[-1].after(token_count.START) == whole
            for i in range(0, len(foreseen), 7):
                assert token_count.prefix_scan(foreseen)[i].after(token_count.START) == t.transducer.through(token_count.START, text[: (i + 1) * chunk])
        assert t.piece(text, 16) == t.transducer.run(text)


def test_foreseen_states_are_mostly_right():
    t = token_count.TokenCounter(words.default_path())
    r = random.Random(4)
    text = "".join(r.choice(["inter", "nation", "al", "q", "zx", "the", "un"]) for _ in range(20_000)).encode()
    maps = token_count.chunk_maps(t.transducer, text, 4096)
    assert token_count.prefix_scan(maps)[-1].after(token_count.START) == t.transducer.through(token_count.START, text)
    assert sum(len(m.known) == 1 for m in maps) >= 0.9 * len(maps)  # not run again


@pytest.mark.parametrize("chunk", [1, 5, 40, 700])
def test_long_stretches_without_white_space_equal_the_library(chunk):
    t = token_count.TokenCounter(words.default_path())
    r = random.Random(7)
    parts = ["a" * 900, "etaoinshrdlu" * 90, "!" * 800, "7" * 300, "日本語" * 200, "'", "'s", "'ll", "''", "'t" * 40, "don't", "é" * 300, "e\u0301" * 200, "가\u1100\u1161\u11a8" * 60, "😀👩\u200d👧" * 50, "İΣς", "²³", "\u0301" * 50, "<|endoftext|>", "<|", "_", "ab1!", "x\u0307\u0323", "ǆ", "\u1100", "\u1161"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(60)] + parts + ["a\u00a0" * 500 + "b" * 900, "\n".join(["word"] * 900), "\u3000".join(parts), "'" + "s" * 2000, "!'" + "s" * 2000, "1'" + "re" * 1000, "x" * 1000 + "'" + "d" * 1000]
    want = [len(t.library.encode(x, add_special_tokens=False).ids) for x in texts]
    assert [i for i, (a, b) in enumerate(zip(t.tokens(texts, chunk), want)) if a != b] == []


@pytest.mark.parametrize("unit", ["x", "word\n", "ab!1", "日本"])
def test_memory_is_linear_in_long_texts(unit):
    import subprocess
    import sys

    code = f"""
import resource
from tessera.llm import token_count, words
t = token_count.TokenCounter(words.default_path())
small = {unit!r} * 1000
t.tokens([small], 256)
text = {unit!r} * (20_000_000 // len({unit!r}.encode()))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = t.tokens([text])[0]
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    n, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rpartition("/tests/")[0]).stdout.split()[-2:])
    t = token_count.TokenCounter(words.default_path())
    some = t.tokens([unit * 2000, unit * 4000])
    assert mb < 250 and abs(n / (20_000_000 // len(unit.encode())) - (some[1] - some[0]) / 2000) < 0.01


def test_bpe_equals_the_library_and_merging():
    import tiktoken

    c = bpe.codec(bpe.default_path())
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    r = random.Random(1)
    for x in some_texts() + ["".join(r.choice("eatnis") for _ in range(300)) for _ in range(200)]:
        ids = c.encode(x)
        assert ids == t.encode_ordinary(x) and c.decode(ids).decode() == x
    piece = b"internationalisations" * 3
    assert [c.bytes_of[i] for i in c.encode_piece(piece)] == bpe.merge_by_rank(piece, c.ranks)


def test_huffman_is_optimal_canonical_and_round_trips():
    import heapq

    r = np.random.default_rng(0)
    n = r.integers(1, 1000, 60)
    heap = [(int(x), i) for i, x in enumerate(n)]
    heapq.heapify(heap)
    cost, i = 0, 60
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost, i = cost + a[0] + b[0], i + 1
        heapq.heappush(heap, (a[0] + b[0], i))
    lengths, _ = huffman.code_lengths(n, 20)
    assert int((lengths * n).sum()) == cost
    skewed = 2 ** np.arange(40)
    lengths, limit = huffman.code_lengths(skewed)
    assert lengths.max() <= limit and sum(2.0 ** -float(x) for x in lengths) <= 1
    for size, vocab in ((0, 5), (1, 5), (255, 9), (256, 9), (257, 9), (50_000, 40_000)):
        ids = np.minimum(r.zipf(1.3, size), vocab - 1).astype(np.uint32)
        book = huffman.Codebook(*huffman.code_lengths(np.bincount(ids, minlength=vocab)))
        docs = [(7, ids[: size // 2]), (None, ids[size // 2 :]), (9, ids[:0])]
        got = book.read_block(book.write_block(docs))
        assert [(i, x.tolist()) for i, x in got] == [(i, x.tolist()) for i, x in docs]


@pytest.mark.parametrize("lengths", [np.clip(np.random.default_rng(1).lognormal(5.5, 1, 5000).astype(int), 1, 2048), np.full(100, 700), np.ones(5000, int), np.array([2048, 1, 2047]), np.empty(0, int), np.random.default_rng(2).integers(900, 1500, 999), np.random.default_rng(3).integers(1, 2048, 3000), np.random.default_rng(4).integers(500, 800, 800)])
def test_packing_covers_all_and_wastes_little(lengths):
    counts = Counter(lengths.tolist())
    plan = packing.plan(counts)
    used = Counter()
    for content, k in plan:
        assert sum(content) <= 2048
        for x in content:
            used[x] += k
    assert used == counts
    n, best = sum(k for _, k in plan), sum(k for _, k in packing.best_fit(counts, 2048))
    assert n <= best
    where = packing.Placement(plan)
    seen = set()
    for length, k in counts.items():
        s, o = where.of(np.full(k, length), np.arange(k))
        seen |= set(zip(s.tolist(), o.tolist()))
    assert len(seen) == len(lengths)


def test_sum_index_equals_counting():
    r = np.random.default_rng(6)
    index = packing.SumIndex(Counter(r.integers(1, 40, 30).tolist()), 100)
    while index.longest(100):
        have = np.flatnonzero(index.n).tolist()
        pairs, triples = Counter(a + b for a in have for b in have), Counter(a + b + c for a in have for b in have for c in have)
        assert all(index.pairs[s] == pairs[s] and index.triples[s] == triples[s] for s in range(101))
        x = have[int(r.integers(len(have)))]
        index.take(x, int(index.n[x]))


def test_bulk_best_fit_equals_one_by_one():
    r = np.random.default_rng(4)
    for _ in range(50):
        lengths = r.integers(1, 60, 80)
        bins = []
        for x in sorted(lengths.tolist(), reverse=True):
            fit = [b for b in bins if b >= x]
            room = min(fit) if fit else 100
            if fit:
                bins.remove(room)
            bins.append(room - x)
        plan = packing.best_fit(Counter(lengths.tolist()), 100)
        assert sorted(100 - sum(c) for c, k in plan for _ in range(k)) == sorted(bins)


def test_shards_are_even_and_bulk_equals_one_by_one():
    r = np.random.default_rng(5)
    sizes = Counter(r.lognormal(6, 1.2, 3000).astype(int).tolist())
    capacity, placed = sharding.smallest_capacity(sizes, 16)
    load = Counter()
    for size, k, b in placed:
        load[b] += size * k
    assert len(load) <= 16 and max(load.values()) <= capacity <= 1.001 * sum(k * v for k, v in sizes.items()) / 16
    assert sum(k for _, k, _ in placed) == 3000
    small = Counter(r.integers(1, 50, 60).tolist())
    rooms: list[int] = []
    for x in sorted(small.elements(), reverse=True):
        fit = [i for i, room in enumerate(rooms) if room >= x]
        if fit:
            rooms[min(fit, key=lambda i: (rooms[i], i))] -= x
        else:
            rooms.append(90 - x)
    load = Counter()
    for size, k, b in sharding.best_fit_decreasing(small, 90):
        load[b] += size * k
    assert [90 - load[i] for i in range(len(rooms))] == rooms
    assert sharding.best_fit_decreasing({5: 3}, 4) is None and sharding.smallest_capacity({}, 4)[1] == []


def test_room_tree_stays_balanced():
    t = sharding.RoomTree()
    for i in range(1000):
        t.add(i, i)
    assert t.root.height <= 14
    assert [t.take_tightest(500)[0] for _ in range(5)] == [500, 501, 502, 503, 504] and t.take_tightest(1000) is None


def brute_fingerprint(text, width=3):
    import re

    import xxhash

    w = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    out = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return out - (1 << 64) if out >> 63 else out


def test_fingerprints():
    for x in some_texts(40) + ["One", "one TWO", "one two three", "É Ä"]:
        assert simhash.fingerprint(x) == brute_fingerprint(x)


def test_anchors_cover_and_meet():
    x = np.random.default_rng(0).integers(0, 2**32, 300, dtype=np.uint32)
    rows, anchor, home = simhash.anchors(x)
    mine = dict(zip(rows[home].tolist(), anchor[home].tolist()))
    assert max(bin(int(x[i]) ^ a).count("1") for i, a in mine.items()) <= 1  # covering radius
    assert all(bin(int(x[i]) ^ int(a)).count("1") <= 2 for i, a in zip(rows.tolist(), anchor.tolist()))
    for e in [0] + [1 << i for i in range(32)]:
        r2, a2, _ = simhash.anchors(x ^ np.uint32(e))
        there = set(zip(r2.tolist(), a2.tolist()))
        assert all((i, a) in there for i, a in mine.items())


def brute_counts(t):
    import re

    w = re.findall("[^\x20\x09-\x0D]+", t)
    spans = {}
    for i in range(len(w) - 7):
        spans.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in spans.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))


def test_rule_counts():
    r = random.Random(2)
    for x in some_texts(60) + ["a b " * 50, "x y z\x1c", "l1\nl1\n\n \nl1"] + [" ".join(r.choice("abc") for _ in range(80)) for _ in range(60)]:
        assert quality_rules.counts(x)[:5] == brute_counts(x)


def some_votes(n=4000, seed=0):
    r = np.random.default_rng(seed)
    truth = r.random(n) < 0.85
    votes = np.where(r.random((n, quality_rules.RULES)) < 0.5, 0, np.where(truth[:, None], np.where(r.random((n, quality_rules.RULES)) < 0.97, 1, -1), np.where(r.random((n, quality_rules.RULES)) < 0.6, -1, 1)))
    return truth, votes


def test_vote_model_finds_the_truth():
    truth, votes = some_votes()
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    m = quality_rules.VoteModel(patterns, n)
    assert ((m.posterior(votes) >= 0.5) == truth).mean() > 0.95
    worst = m.posterior(np.full((1, quality_rules.RULES), -1))
    assert worst[0] < 0.5 < m.posterior(np.full((1, quality_rules.RULES), 1))[0]
    assert quality_rules.VoteModel(np.empty((0, quality_rules.RULES)), np.empty(0)).prior == 0.8


def test_vote_model_is_em_of_its_own_likelihood():
    _, votes = some_votes(60, 1)
    votes[:, 0] = np.where(votes[:, 1] != 0, -votes[:, 1], 0)  # a rule that would be worse than chance
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    m = quality_rules.VoteModel(patterns, n, rounds=1)
    before = m.log_likelihood(patterns, n)
    for _ in range(40):
        m.maximise(patterns, n.astype(float), m.posterior(patterns))
        now = m.log_likelihood(patterns, n)
        assert now >= before - 1e-9
        before = now
    assert (m.accuracy.sum(0) >= 1 - 1e-12).all()
    # posterior and likelihood by definition, one text at a time
    prior = quality_rules.PRIOR_VOTES * (sum(0.8 * np.log(a) + 0.2 * np.log(1 - a) for a in m.accuracy.ravel()) + 0.8 * np.log(m.prior) + 0.2 * np.log(1 - m.prior))
    total = 0.0
    for row in votes:
        p = {1: m.prior, 0: 1 - m.prior}
        for y in (0, 1):
            for j, v in enumerate(row):
                if v:
                    p[y] *= m.accuracy[y, j] if (v > 0) == (y == 1) else 1 - m.accuracy[y, j]
        total += np.log(p[0] + p[1])
        assert m.posterior(row[None])[0] == pytest.approx(p[1] / (p[0] + p[1]), abs=1e-9)
    assert before == pytest.approx(total + prior, abs=1e-6)


def test_ratio_model_on_held_out_labels():
    import duckdb

    rows = duckdb.sql("SELECT text, quality, coalesce(toxic, 0) FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) ORDER BY doc_id LIMIT 1500").fetchall()
    raw, target = np.zeros(2 << 16), np.zeros(2 << 16)
    for i, (text, q, tox) in enumerate(rows):
        b = importance.buckets(text)
        np.add.at(raw, b, 1)
        if i % 2 and q == 1 and not tox:
            np.add.at(target, b, 1)
    m = importance.RatioModel(raw, target)
    held = [(m.score(t), q == 1) for i, (t, q, tox) in enumerate(rows) if not i % 2]
    s, good = np.array([x for x, _ in held]), np.array([g for _, g in held])
    m.calibrate(s[::2], good[::2])
    keep = s[1::2] >= m.cutoff
    assert keep[good[1::2]].mean() > 0.97 and keep[~good[1::2]].mean() < 0.2
    m.calibrate(s[good], good[good])
    assert m.score("") == 0


def test_network_gradients_and_learning():
    r = np.random.default_rng(0)
    net = masked_lm.WindowNetwork.fresh(np.ones(masked_lm.CLASSES))
    # the middle word is a function of its neighbours: learnable from both sides only
    left, right = r.integers(0, 8, 6000), r.integers(0, 8, 6000)
    context = np.stack([r.integers(0, 8, 6000), left, right, r.integers(0, 8, 6000)])
    target = (left * 8 + right) % 40

    def loss():
        return -net.log_probabilities(context, target).mean()

    for k, shape in masked_lm.WindowNetwork.SHAPES.items():  # every weight's gradient by differences
        if k == "embed":
            continue
        at = tuple(int(r.integers(0, n)) for n in shape)
        want, w = net.gradients(context, target)[0][k][at], net.w[k][at]
        net.w[k][at] = w + 0.05
        up = loss()
        net.w[k][at] = w - 0.05
        assert (up - loss()) / 0.1 == pytest.approx(float(want), abs=2e-3)
        net.w[k][at] = w
    before = loss()
    squares = {k: np.full(s, masked_lm.START, np.float32) for k, s in masked_lm.WindowNetwork.SHAPES.items()}
    for _ in range(60):
        net.train(context, target, squares)
    assert loss() < before / 2
    c = context[:, :1].repeat(masked_lm.CLASSES, 1)
    assert np.exp(net.log_probabilities(c, np.arange(masked_lm.CLASSES))).sum() == pytest.approx(1, abs=1e-3)
    assert np.allclose(masked_lm.WindowNetwork.from_flat(np.frombuffer(net.to_bytes(), "<f4")).w["embed"], net.w["embed"])


def test_vocabulary_adds_up_and_reader_equals_looking_up():
    r = random.Random(4)
    corpus = [r.choice("abcdefgh") * r.randint(1, 3) + str(r.randint(0, 300)) for _ in range(9000)]
    n = Counter(x.encode() for x in corpus)
    keys = dict(zip(n, masked_lm.keys_of(n).tolist()))
    order = sorted(n, key=lambda w: (-n[w], keys[w]))
    own, shared = order[: masked_lm.OWN_CLASSES], order[masked_lm.OWN_CLASSES :]
    listed = shared[: len(shared) // 2]
    totals, kinds = np.zeros(masked_lm.CLASSES), np.zeros(masked_lm.CLASSES)
    totals[: len(own)] = [n[w] for w in own]
    for w in shared:
        c = masked_lm.shared_class(keys[w])
        totals[c], kinds[c] = totals[c] + n[w], kinds[c] + 1
    v = masked_lm.Vocabulary.of(np.array([keys[w] for w in own]), np.array([keys[w] for w in listed]), np.array([n[w] for w in listed], float), totals, kinds)
    cls, p = v.look_up(np.array([keys[w] for w in order]))
    assert cls[: len(own)].tolist() == list(range(len(own))) and not p[: len(own)].any()
    for c in range(masked_lm.OWN_CLASSES, masked_lm.CLASSES):  # each class's words and one unseen word add up to one
        if kinds[c]:
            assert np.exp(p[cls == c].astype(float)).sum() + np.exp(float(v.rest[c])) == pytest.approx(1, abs=1e-4)
    text = " ".join(corpus[:500] + ["unseen"])
    (c, total, no_keys), (none, zero, _) = masked_lm.Reader(v).read([text, ""])
    want = v.look_up(masked_lm.keys_of(text.encode().split()))
    assert c.tolist() == want[0].tolist() and total == pytest.approx(float(want[1].sum()), abs=1e-3) and len(none) == 0 and zero == 0
