"""Prefix tries (11), packing (12) and resampling towards a target (13) against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from cairn.llm import packing, resampling, trie
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")
JSON = P.path("byte_bpe_50k.json")


# --- 11


def content(role, text):
    return role or "", text or ""


def ordered(rows):
    """Turns of each conversation, by turn (null first), then by the hash that stands for role and text."""
    out = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = content(role, text)
            out[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [x[3:] for x in sorted(t)] for c, t in out.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    members = collections.defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p in members:
        own = (len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += own
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def random_conversations(seed, n, words, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 4 * n), n):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([turn, turn, turn, None, 0]), rng.choice(["user", "user", None, ""]), rng.choice([*words, None, ""])))
    return rows


@pytest.mark.parametrize("seed,n,words,longest,block", [(1, 60, ["a", "b c"], 6, 64), (2, 150, ["a"], 9, 2), (3, 200, ["a", "b", "c d e", "漢 é"], 5, 1), (4, 40, ["a", "b"], 40, 3), (5, 1, ["a"], 3, 64)])
def test_trie_is_that_of_brute_force(spark, seed, n, words, longest, block):
    rows = random_conversations(seed, n, words, longest)
    rows += rows[:5] + [(None, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).selectExpr("*", "'clash' AS conv", "1 AS d", "2 AS n", "'x' AS content", "'k' AS `key`")
    for turns, convs in ((trie.rebuilt(trie.numbered(df)), rebuilt(ordered(rows))), (trie.with_length(trie.numbered(df)), ordered(rows))):
        got = trie.prefix_trie(turns, block)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(convs)


def test_trie_of_many_alike_and_very_long_conversations(spark):
    """Deep prefixes that go through many ranges, thousands of copies, ends within others, and a chain of blocks."""
    rows = []
    for c in range(900):
        turns = ["a"] * (c % 30) + (["b", str(c % 7)] if c % 3 else [])
        rows += [(c, i, "user", t) for i, t in enumerate(turns)]
    rows += [(5000, i, "user", "a") for i in range(700)] + [(5001, i, "user", "a" if i < 650 else "z") for i in range(690)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    convs = ordered(rows)
    got = trie.prefix_trie(trie.with_length(trie.numbered(df)), 4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(convs)


def test_trie_of_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(trie.rebuilt(trie.numbered(df))).count() == 0
    df = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(trie.rebuilt(trie.numbered(df))).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_ranges_know_of_points_that_others_make(seed):
    """The compressed tree of sorted sequences is the same however they are split in ranges."""
    rng = random.Random(seed)
    some = sorted({tuple(rng.choice("aab") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 40))})
    # a turn's hash depends on its place
    seqs = sorted(b"".join(hashlib.md5(f"{i}:{s}".encode()).digest() for i, s in enumerate(q)) for q in some)

    def tree(cuts):
        parts = [seqs[a:b] for a, b in itertools.pairwise([0, *cuts, len(seqs)]) if b > a]
        lcps = [[None, *(trie._shared(a, b) for a, b in itertools.pairwise(p))] for p in parts]
        left, right = [[] for _ in parts], [[] for _ in parts]
        meet = [trie._shared(a[-1], b[0]) for a, b in itertools.pairwise(parts)]
        for p in range(1, len(parts)):
            left[p] = trie._lows([meet[p - 1], *reversed(lcps[p - 1][1:]), *left[p - 1]])
        for p in range(len(parts) - 2, -1, -1):
            right[p] = trie._lows([meet[p], *lcps[p + 1][1:], *right[p + 1]])
        found = {}
        for part, lcp, a, b in zip(parts, lcps, left, right, strict=True):
            n = len(part)
            rows = {"k": [0] * n, **{c: [0] * n for c in trie._STARTS}, "seq": part, "words": [[1] * (len(s) // 16) for s in part], "n": [1] * n, "least": [0] * n, "ends": [1] * n, "lcp": lcp}
            for key, above, top, count, _, ends, tails in trie._Range(rows, 64).run([v for v in a if v > 0], [v for v in b if v > 0]):
                old = found.setdefault(key, [above, top, tails, 0, 0])
                assert old[:3] == [above, top, tails]
                old[3] += count
                old[4] += ends
        return found

    whole = tree([])
    assert whole[b"\0" * 16][3] == len(seqs)
    for _ in range(5):
        assert tree(sorted(rng.sample(range(len(seqs) + 1), min(len(seqs), rng.randint(1, 8))))) == whole


# --- 12


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


PIECES = ["a", " b", "\n\t ", "'ll", "12", "é", "漢", " ", "<|endoftext|>", "<|", "!?", "The ", "\r", "𝟘", "Ⅷ", "　", "\x1c"]


def test_ids_are_those_of_the_tokenizer(tokenizer):
    codec = packing.Codec(JSON, P.PATTERN)
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    for text in ("x" * 3000, " " * 3000, "ab " * 50_000, "é" * 999 + "<|endoftext|>" * 3):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check_plan(sizes, capacity):
    runs, total = packing.planned(sizes, capacity)
    used = collections.defaultdict(list)
    numbers = collections.defaultdict(list)
    for r in runs:
        for nth in range(r.items):
            numbers[r.size].append(r.since + nth)
            used[r.first + nth // r.each].append((r.offset + nth % r.each * r.size, r.size))
    assert {s: sorted(v) for s, v in numbers.items()} == {s: list(range(n)) for s, n in sizes.items() if n}
    assert sorted(used) == list(range(total))
    for parts in used.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
        assert sum(3 * s > capacity for _, s in parts) <= 2
    return total, len(runs)


def best_fit(sizes, capacity):
    """One item at a time: large ones matched, then each into the smallest gap that holds it."""
    items = sorted((s for s, n in sizes.items() for _ in range(n)), reverse=True)
    large, gaps = [s for s in items if 3 * s > capacity], []
    while large:
        s = large.pop(0)
        fit = next((x for x in large if x <= capacity - s), None)
        if fit:
            large.remove(fit)
        gaps.append(capacity - s - (fit or 0))
    for s in (s for s in items if 3 * s <= capacity):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((capacity if fit is None else fit) - s)
    return len(gaps)


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_that_of_one_item_at_a_time(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 7, 10, 30, 100])
    sizes = {s: rng.choice([0, 1, 2, 5, 17]) for s in range(1, capacity + 1) if rng.random() < rng.choice([0.2, 0.9])}
    assert check_plan(sizes, capacity)[0] == best_fit(sizes, capacity)


def most_pairs(large, capacity):
    """The largest number of pairs, by trying all."""
    if len(large) < 2:
        return 0
    first, rest = large[0], large[1:]
    best = most_pairs(rest, capacity)
    for i, other in enumerate(rest):
        if first + other <= capacity:
            best = max(best, 1 + most_pairs(rest[:i] + rest[i + 1 :], capacity))
    return best


@pytest.mark.parametrize("seed", range(40))
def test_matching_makes_as_many_pairs_as_can_be(seed):
    rng = random.Random(seed)
    large = [rng.randint(11, 30) for _ in range(rng.randint(0, 8))]
    assert packing.planned(collections.Counter(large), 30)[1] == len(large) - most_pairs(large, 30)


def test_plan_stays_short_for_any_number_of_items():
    rng = random.Random(3)
    sizes = {s: rng.randint(1, 10**7) for s in range(1, 1025)}
    runs, total = packing.planned(sizes)
    assert len(runs) < 20_000
    assert sum(r.items for r in runs) == sum(sizes.values())
    tokens = sum(s * n for s, n in sizes.items())
    assert -(-tokens // 1024) <= total


def check_packed(rows, texts, tokenizer, capacity, digest):
    """rows: the packed pieces; texts: by id, those of all rows with it."""
    by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32 if digest else tuple(r.ids)))
    for parts in by_sequence.values():
        assert [o for o, _ in sorted(parts)] == [0, *itertools.accumulate(n for _, n in sorted(parts))][:-1]
        assert sum(n for _, n in parts) <= capacity
    want = collections.defaultdict(list)
    for i, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        starts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity)]
        for p, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            own = tuple(ids[a:b])
            want[i].append((p, a, b - a, zlib.crc32(np.array(own, "<u4").tobytes()) if digest else own))
    assert {i: sorted(v) for i, v in by_doc.items()} == {i: sorted(v) for i, v in want.items()}


@pytest.mark.parametrize("digest,capacity", [(True, 1024), (False, 64)])
def test_packed_table(spark, odd, none, tokenizer, digest, capacity):
    texts = [(r[0], r[1]) for r in ODD]
    got = packing.packed(odd.repartition(3), JSON, P.PATTERN, capacity, digest=digest)
    check_packed(got.collect(), texts, tokenizer, capacity, digest)
    assert packing.packed(none, JSON, P.PATTERN, digest=digest).count() == 0
    if not digest:
        rows = packing.sequences(got).collect()
        assert all(len(r.ids) == sum(p.length for p in r.docs) <= capacity for r in rows)
        assert sum(len(r.ids) for r in rows) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)


# --- 13


def brute_weights(docs, target, n, buckets):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return words, [zlib.crc32(" ".join(words[i : i + m]).encode()) % buckets for m in range(1, n + 1) for i in range(len(words) - m + 1)]

    found = [features(t) for _, t in docs]
    s, t = collections.Counter(b for _, f in found for b in f), collections.Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for (i, _), (words, f) in zip(docs, found, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append((i, len(words), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


def ranked(rows, least, percent):
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    k = percent * len(fit) // 100
    drawn = [(i, f, w, s, n + 1) for n, (i, _, f, w, s) in enumerate(fit[:k])]
    return sorted([*drawn, *((i, f, w, s, None) for i, _, f, w, s in fit[k:]), *((i, f, w, s, None) for i, words, f, w, s in rows if words < least)], key=str)


@pytest.mark.parametrize("n,chunk,least,percent", [(1, 1 << 16, 20, 10), (1, 64, 3, 60), (2, 40, 3, 50), (3, 17, 1, 100), (4, 5, 2, 30)])
def test_resampling_is_that_of_brute_force(spark, n, chunk, least, percent):
    rng = random.Random(n * chunk)
    words = ["The", "cat", "SAT", "on", "mat-12", "é漢", "x" * 50, "a", "...", "\x85\xa0"]
    docs = [(i if i % 9 else None, " ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 25, 60])))) for i in range(120)]
    docs += docs[:7] + [(500, None), (501, ""), (502, "word " * 20_000), (503, "y" * 100_000 + " z"), (504, " " * 5000)]
    target = ["the cat sat on the mat", None, "", "x " * 30]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).selectExpr("*", "'clash' AS score", "1 AS words", "2 AS own", "3 AS id")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resampled(df, goal, n=n, least_words=least, percent=percent, chunk=chunk, buckets=997)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(brute_weights(docs, target, n, 997), least, percent)


def test_chunks_own_every_start_once():
    rng = random.Random(7)
    for _ in range(300):
        n, chunk = rng.randint(1, 4), rng.randint(1, 30)
        signs = "".join(rng.choice("ab  c") for _ in range(rng.randint(0, 120))).encode()
        whole = collections.Counter(f for some in resampling.owned(signs.split(), len(signs.split()), n) for f in some)
        parts = collections.Counter()
        for words, own in resampling.chunks(signs, chunk, n):
            split = words.split()
            assert len(split) <= own + n - 1
            parts += collections.Counter(f for some in resampling.owned(split, own, n) for f in some)
        assert parts == whole


def test_resampling_of_odd_and_empty_tables(spark, odd, none):
    goal = spark.createDataFrame([("some text",)], "text string")
    docs = [(r[0], r[1]) for r in ODD]
    got = resampling.resampled(odd, goal, percent=100, least_words=1)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(brute_weights(docs, ["some text"], 1, 10_000), 1, 100)
    assert resampling.resampled(none, goal).count() == 0
    assert resampling.resampled(odd, goal.where("false")).count() == len(ODD)
