"""Operators over many rows: quality (1), chat (3), decontamination (5), SimHash (6), neighbours (7), WARC (9), pipeline."""

import collections
import itertools
import gzip
import math
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import chat, decontaminate, hamming, jaccard, neighbours, quality, simhash, tokens, warc
from cairn.operators.components import connected
from tests.llm.conftest import ODD, SCHEMA


def brute_fingerprint(text, k=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["the ", "Fox", "É ", " ", "\t", "\n", "ab ", "c ", " "]) for _ in range(rng.randint(0, 80)))
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    # the same hash as Spark's own
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] == np.uint64(xxhash.xxh64_intdigest(b"a b c", 42)).view(np.int64)


def test_windows():
    h = np.random.default_rng(1).integers(0, 2**64, 300, dtype=np.uint64)
    for n in (1, 2, 37, 254):
        w = tokens.simhash_windows(h, n)
        assert len(w) == len(h) - n + 1 and all(int(w[i]) == tokens.simhash(h[i : i + n]) for i in range(0, len(w), 11))
    assert len(tokens.simhash_windows(h[:3], 4)) == 0 and tokens.simhash(h[:0]) == 0


def test_hashed_tokens_do_not_depend_on_place():
    long = "word " * 900_000  # more than a piece
    h, b = tokens.hashed(["Word", None, "", long, "a" * 3_000_000, "word é"])
    assert np.diff(b).tolist() == [1, 0, 0, 900_000, 1, 2] and set(h[1:900_001].tolist()) == {int(h[0])} and h[-2] == h[0]
    s, sb = tokens.shingled(h, b, 5)
    assert np.diff(sb).tolist() == [1, 0, 0, 899_996, 1, 1]


def close_groups(prints, radius):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def near_prints(n, seed=1):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 3)]
    return base + [rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(n - len(base))]


@pytest.mark.parametrize("leaf", [4096, 8])
def test_tree_finds_all_close_pairs(spark, leaf):
    prints = sorted(set(near_prints(240)))
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long").repartition(3)
    found = {r.node: r.root for r in connected(hamming.close_links(df, 3, leaf=leaf)).collect()}
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    want = close_groups(prints, 3)
    ours = [found.get(s, s) for s in signed]
    assert all((want[i] == want[j]) == (ours[i] == ours[j]) for i in range(len(prints)) for j in range(i))


def test_routes_cover_close_pairs():
    x = np.array(near_prints(300, 7), np.uint64)
    tree = hamming.build(x, 5)
    row, leaf, home = hamming.route(tree, x, 3)
    homes = {int(r): int(k) for r, k in zip(row[home], leaf[home], strict=True)}
    reach = set(zip(row.tolist(), leaf.tolist(), strict=True))
    d = np.bitwise_count(x[:, None] ^ x[None, :])
    assert len(homes) == len(x) and all((int(i), homes[int(j)]) in reach or (int(j), homes[int(i)]) in reach for i, j in zip(*np.nonzero(d <= 3), strict=True))


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(hamming, "HOME_ROWS", 20)
    monkeypatch.setattr(hamming, "GUEST_ROWS", 30)
    prints = sorted(set(near_prints(150, 3)))
    df = spark.createDataFrame([(1, int(np.uint64(p).view(np.int64))) for p in prints], "leaf int, fp long")
    found = {r.node: r.root for r in connected(hamming.dealt_links(df, df, ["leaf"], ["fp"], 3)).collect()}
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    want, ours = close_groups(prints, 3), [found.get(s, s) for s in signed]
    assert all((want[i] == want[j]) == (ours[i] == ours[j]) for i in range(len(prints)) for j in range(i))


def test_grouped(spark, odd, none):
    got = simhash.grouped(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[2].fingerprint == by[3].fingerprint == by[4].fingerprint == "0" * 16 and by[2].component_id == by[4].component_id == 2
    assert all(by[i].fingerprint == f"{brute_fingerprint(t):016x}" for i, t, *_ in ODD)
    assert by[1].component_id == 1
    assert simhash.grouped(none).count() == 0


def test_grouped_by_brute_force(spark):
    """Component ids of a whole table: texts whose fingerprints are chained, copies, repeated rows, a hub."""
    rng = random.Random(31)
    rows = []
    for _ in range(25):
        w = words(rng, 300)
        for _ in range(rng.randint(1, 5)):
            rows.append((rng.randint(0, 10_000), " ".join(w)))
            w[rng.randrange(300)] = "other"
    rows += [(7, None), (3, ""), (20_000, rows[0][1]), rows[1], rows[1]]
    rows += [(30_000 + i, rows[2][1]) for i in range(400)]
    prints = [brute_fingerprint(t) for _, t in rows]
    groups = close_groups(prints, 3)
    least = {}
    for (i, _), g in zip(rows, groups, strict=True):
        least[g] = min(i, least.get(g, i))
    got = simhash.grouped(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, groups, strict=True))
    assert len(set(least.values())) < len(set(prints))


def words(rng, n):
    return [f"w{rng.randint(0, 5000)}" for _ in range(n)]


def test_deduplicated(spark, odd, none):
    rng = random.Random(8)
    docs, groups = [], 0
    for k in range(40):
        base = words(rng, 200)
        groups += 1
        docs.append((k * 10 + 1, " ".join(base)))
        if k % 2:
            docs.append((k * 10 + 2, " ".join(base)))  # a copy
        if k % 3 == 0:
            near = list(base)
            near[100] = "changed"
            docs.append((k * 10, " ".join(near)))  # ten shingles of 392 differ, and it has the smallest id
    docs += [(1000 + i, " ".join(words(rng, 200))) for i in range(70)]  # one shard's worth of others
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], SCHEMA).repartition(3)
    kept = sorted(r.doc_id for r in simhash.deduplicated(df).collect())
    assert kept == sorted([k * 10 + (0 if k % 3 == 0 else 1) for k in range(40)] + [1000 + i for i in range(70)])
    left = simhash.deduplicated(odd)
    assert left.columns == odd.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 5, 6, 7]
    assert simhash.deduplicated(none).count() == 0


def varied(seed=5, families=12):
    """Families of texts whose members are alike to any degree around 0.8, some in chains."""
    rng = random.Random(seed)
    docs = []
    for _ in range(families):
        base = words(rng, rng.choice((6, 40, 150, 400)))
        for _ in range(rng.randint(2, 12)):
            own = list(base)
            for at in rng.sample(range(len(own)), min(len(own), rng.randint(0, max(1, len(own) // 25)))):
                own[at] = f"x{rng.randint(0, 10**6)}"
            docs.append(" ".join(own))
            if rng.random() < 0.4:
                base = own
    rng.shuffle(docs)
    return list(enumerate(docs))


def sets_of(docs, k=5):
    out = []
    for _, text in docs:
        w = text.split()
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))})
    return out


def brute_groups(docs, similarity=0.8):
    sets, parent = sets_of(docs), np.arange(len(docs))
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9]
    if pairs:
        parent = hamming.unite(parent, *map(np.array, zip(*pairs, strict=True)))
    return hamming.roots(parent)


def test_deduplicated_at_the_similarity(spark):
    docs = varied()
    want = sorted(set(brute_groups(docs).tolist()))
    assert 20 < len(want) < len(docs) - 10
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], SCHEMA).repartition(3)
    assert sorted(r.doc_id for r in simhash.deduplicated(df).collect()) == want


def test_deduplicated_short_texts(spark):
    """Texts of few shingles: one word more (4 against 5 shingles, 0.8), and 12 shared of 15."""
    rng = random.Random(21)
    docs = []
    for _ in range(120):
        w = words(rng, 8)
        docs += [" ".join(w), " ".join([*w, f"more{rng.randint(0, 10**6)}"])]
    for _ in range(60):
        w = words(rng, 17)
        docs += [" ".join([*w[:16], "x1"]), " ".join([*w[:16], f"y{rng.randint(0, 10**6)}", "z"])]
    docs = list(enumerate(docs))
    want = sorted(set(brute_groups(docs).tolist()))
    assert len(want) <= len(docs) - 120
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], SCHEMA).repartition(3)
    assert sorted(r.doc_id for r in simhash.deduplicated(df).collect()) == want


@pytest.mark.parametrize("looked_up", [0, 64, 10**9])
def test_united_by_brute_force(monkeypatch, looked_up):
    monkeypatch.setattr(jaccard, "LOOKED_UP", looked_up)
    docs = varied(14, 30)
    sets = [np.frombuffer(jaccard.packed(np.array([xxhash.xxh64_intdigest(" ".join(s)) for s in own], np.uint64)), np.uint32) for own in sets_of(docs)]
    sets += [np.zeros(0, np.uint32)] * 2
    got = jaccard.united(sets, np.arange(len(sets)), len(sets), 0.8)
    assert hamming.roots(got).tolist() == [*brute_groups(docs).tolist(), len(docs), len(docs) + 1]


@pytest.mark.parametrize("block", [1 << 20, 9000])
def test_verified_links(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "ACROSS", 16)
    docs = varied(9)
    rows = [(i % 2, i, jaccard.packed(np.array([xxhash.xxh64_intdigest(" ".join(s)) for s in own], np.uint64))) for (i, _), own in zip(docs, sets_of(docs), strict=True)]
    spark.createDataFrame(rows, "root long, key long, grams binary").write.parquet(str(tmp_path / "m"))
    links = jaccard.verified_links(spark.read.parquet(str(tmp_path / "m")), 0.8).collect()
    for half in (0, 1):
        own = [d for d in docs if d[0] % 2 == half]
        place = {d[0]: k for k, d in enumerate(own)}
        some = [(place[r.a], place[r.b]) for r in links if r.a % 2 == half]
        found = hamming.unite(np.arange(len(own)), *map(np.array, zip(*some, strict=True)))
        assert hamming.roots(found).tolist() == brute_groups(own).tolist()


def test_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = words(rng, 300)
    docs = []
    for i in range(200):
        own = list(base)
        own[i] = "other"
        docs.append((i, " ".join(own), None, None, None))
    assert [r.doc_id for r in simhash.deduplicated(spark.createDataFrame(docs, SCHEMA)).collect()] == [0]


def brute_items(text, items):
    def grams(t, k=5):
        w = "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else [])

    found, own = {}, grams(text or "")
    for i, t in items:
        want = grams(t or "")
        if want and len(want[0]) < 5:  # a short item: its words in a row
            if want[0] in grams(text or "", len(want[0])):
                found[i] = 1.0
            continue
        n = min(len(want), len(own))
        for a in range(len(own) - n + 1) if n else ():
            x, y = {}, {}
            for g in own[a : a + n]:
                x[g] = x.get(g, 0) + 1
            for g in want:
                y[g] = y.get(g, 0) + 1
            both = sum(min(v, y.get(g, 0)) for g, v in x.items())
            s = both / (n + len(want) - both)
            if s >= 0.8:
                found[i] = max(found.get(i, 0), s)
    return found


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(i, " ".join(words(rng, rng.randint(20, 60)))) for i in range(30)] + [(90, None), (91, ""), (92, "one two"), (93, " ".join(words(rng, 400))), (94, "Alone"), (95, "alone"), (96, "five is not short now")]
    docs = []
    for d in range(60):
        w = words(rng, rng.randint(5, 300))
        if d % 2:
            i = rng.randrange(30)
            passage = items[i][1].split()
            if d % 3 == 0:
                passage = passage[2:]  # cut off
            if d % 5 == 0:
                passage[-2] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = [passage[0].upper() + ",", *passage[1:]]
        docs.append((d, " ".join(w)))
    docs += [(100, items[33][1]), (101, "one two"), (102, items[3][1] + "."), (103, None), (104, "")]
    docs += [(105, "here One, two and three"), (106, "one"), (107, "two one"), (108, "all alone"), (109, "five is not short"), (110, "so five is not short now it")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r["items"], round(r.similarity, 6)) for r in decontaminate.contaminated(df, bench).collect()}
    short = [x for x in items if x[0] != 93]
    for d, t in docs:
        want = brute_items(t, short)
        assert got[d][0] == sorted({*want, *([93] if d == 100 else [])}), d
        assert d == 100 or got[d][1] == round(max(want.values(), default=0.0), 6)
    again = {r.doc_id: r["items"] for r in decontaminate.contaminated(df, bench, pass_chars=2000).collect()}
    assert again == {d: v[0] for d, v in got.items()}


def test_decontamination_cases(spark, odd, none):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog again")], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.contaminated(odd, bench).collect()}
    assert got[1] == [1] and all(v == [] for k, v in got.items() if k != 1)
    assert decontaminate.contaminated(odd, bench.where("item_id > 5")).where("n_items > 0").count() == 0
    assert decontaminate.contaminated(none, bench).count() == 0
    kept = decontaminate.contaminated(odd, bench, keep=("root", "__text", "id")).collect()
    assert len(kept) == len(ODD) and {r["root"] for r in kept} == {"clash"} and sum(r.n_items for r in kept) == 2
    with pytest.raises(ValueError):
        decontaminate.contaminated(odd, bench, keep=("similarity",))


@pytest.mark.parametrize("blocks", [4, 5])
def test_multi_index_misses_nothing(blocks):
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**64, 70, dtype=np.uint64)
    windows = np.array([int(p) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for p in prints for k in (0, 5, 12, 19, 20)], np.uint64)
    w, i = decontaminate.candidates(windows, prints, decontaminate.multi_index(prints, 19, blocks), 19)
    a, b = np.nonzero(np.bitwise_count(windows[:, None] ^ prints[None, :]) <= 19)
    assert sorted(zip(w, i, strict=True)) == sorted(zip(a, b, strict=True))


def test_quality(spark, odd, none):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        good = i % 4 > 0
        text = [rng.choice(["river", "stone", "cloud", "tree", "green", "walks", "slowly", "north"]) + str(rng.randint(0, 30)) for _ in range(60)]
        if not good:
            text[20:24] = ["awful", "trash", "awful", "words"] if i % 8 else ["same"] * 4
        rows.append((i, " ".join(text)))
        if i % 2:
            labels.append((i, int(good or i % 8 > 0), int(not good and i % 8 > 0)))
    for i in range(0, 600, 4):
        labels.append((i, 0, 0)) if i % 8 == 0 and i < 300 else None
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.resampled(df, lab).collect()}
    good = [got[i] for i in range(600) if i % 4]
    assert sum(good) / len(good) > 0.95 and sum(got[i] for i in range(0, 600, 8)) <= 8
    kept = {r.doc_id for r in quality.filtered(df, lab).collect()}
    assert kept == {i for i, k in got.items() if k}
    assert {r.doc_id: r.kept for r in quality.resampled(df.repartition(7), lab).collect()} == got


def brute_weights(rows, good):
    """Log ratios of two n-gram models, from words themselves instead of hash buckets."""
    def grams(text):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+|[^0-9a-z\x80-\U0010ffff\s]+", text.lower())
        once, runs, length = set(w), [], 0
        for a, b in zip(w, w[1:]):
            length = length + 1 if a == b else 0
            if length:
                runs.append(("run", min(length, 3)))
            else:
                once.add((a, b))
        return w, once, runs

    raw, own = collections.Counter(), collections.Counter()
    for i, text in rows:
        _, once, runs = grams(text)
        for g in [*once, *runs]:
            raw[g] += 1
            own[g] += good.get(i, False)
    single = [g for g in raw if g[0] != "run" or len(g) != 2 or not isinstance(g[1], int)]
    share = sum(own[g] for g in single) / sum(raw[g] for g in single)
    out = {}
    for i, text in rows:
        w, _, _ = grams(text)
        total, length = 0.0, 0
        for k, a in enumerate(w):
            gs = [a]
            if k + 1 < len(w):
                length = length + 1 if a == w[k + 1] else 0
                gs.append(("run", min(length, 3)) if length else (a, w[k + 1]))
            for g in gs:
                leave = 0 if g[0] == "run" and len(g) == 2 and isinstance(g[1], int) else 1
                e, s = (raw[g] - leave) * share, own[g] - leave * good.get(i, False)
                r = math.log((s + quality.SMOOTHING) / (e + quality.SMOOTHING))
                total += math.copysign(max(0, abs(r) - quality.ERRORS / math.sqrt(e + 2)), r)
        out[i] = total
    return out


def test_quality_by_brute_force(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(["river", "stone", "cloud", "tree", "green"]) + str(rng.randint(0, 40)) for _ in range(rng.randint(3, 60))]
        if i % 3 == 0:
            text[1:1] = ["awful"] * rng.randint(1, 5)
        rows.append((i, " ".join(text) + "!" * (i % 2)))
        if i % 2:
            labels.append((i, int(i % 3 > 0), int(i % 30 == 1)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.resampled(df, lab).collect()}
    good = {i: bool(q and not t) for i, q, t in labels}
    want = brute_weights(rows, good)
    assert max(abs(got[i].log_weight - w) for i, w in want.items()) < 0.05 + 0.002 * max(abs(w) for w in want.values())  # ratios are kept as half-precision numbers
    # k is read off the labelled rows; the sample is the k largest keys, which isn't the k largest weights
    cut = quality.best_cut(np.array([got[i].log_weight for i in good]), np.array(list(good.values())))
    k = sum(r.log_weight >= cut for r in got.values())
    order = sorted(got.values(), key=lambda r: -r.gumbel_key)
    assert {r.doc_id for r in order[:k]} == {i for i, r in got.items() if r.kept}
    noise = np.array([r.gumbel_key - r.log_weight for r in got.values()])
    assert abs(noise.mean() - 0.5772) < 0.15 and abs(noise.std() - 1.2825) < 0.15
    half = quality.resampled(df, lab, share=0.5).where("kept").collect()
    assert len(half) == 450 and {r.doc_id for r in half} == {r.doc_id for r in order[:450]}
    assert {r.doc_id for r in half} != {r.doc_id for r in sorted(got.values(), key=lambda r: -r.log_weight)[:450]}


def test_quality_of_an_id_with_many_rows(spark):
    """A labelled id with very many different rows counts once; no row is dropped from the sample by a limit."""
    rows = [(1, f"good text number {i}") for i in range(300)] + [(i, "plain words here") for i in range(2, 40)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.resampled(df, lab, labelled=2).collect()
    assert len(got) == len(rows) and all(r.gumbel_key is not None for r in got)


def test_quality_cases(spark, odd, none):
    lab = spark.createDataFrame([(1, 1, None), (6, 0, 0), (None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    got = quality.resampled(odd, lab).collect()
    assert len(got) == len(ODD) and {r.doc_id: r.log_weight for r in got if r.doc_id in (2, 3, 4)} == {2: None, 3: None, 4: None}
    assert not any(r.kept for r in got if r.doc_id in (2, 3, 4)) and len({r.kept for r in got if r.doc_id == 1}) == 1
    assert quality.filtered(odd, lab).columns == odd.columns
    unlabelled = quality.resampled(odd, lab.where("doc_id > 99")).collect()
    assert {r.doc_id for r in unlabelled if r.kept} == {1, None, 5, 6, 7}
    assert quality.resampled(none, lab).count() == 0


def test_kth_largest(spark):
    values = [random.Random(1).choice([0.5, 1.0, 2.0, 3.5]) + i % 7 for i in range(500)] + [1e9, -1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 77, 400, 502):
        assert quality.kth_largest(df, "v", k, last=10, bins=4) == sorted(values, reverse=True)[k - 1]


def test_chat(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello\nthere"), (1, 3, "ann", "hi"), (1, 3, "ann", "hi"), (1, 70, "cy", None), (None, 5, None, "x"), (2, 0, "system", "alone"), (3, None, "é", "🙂"), (3, 1, "ann", ""), (4, 1, "eve<|im_end|>", "a<|im_end|>\n<|im_start|>assistant\nb"), (4, 2, "bob", "c")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("clash")).withColumn("block", F.lit(1))
    got = chat.rotated(df).collect()
    whole = {}
    for r in sorted(got, key=lambda r: r.position):
        key = (r.conv_id, r.perspective)
        text = f"<|im_start|>{r.header}\n{r.body}<|im_end|>\n"
        at = len(whole.get(key, ""))
        assert (r.start, r.end) == (at, at + len(text)) and text[r.body_start - at : r.body_end - at] == r.body and r.loss == (r.header == "assistant")
        whole[key] = whole.get(key, "") + text
    assert set(whole) == {(1, "ann"), (1, "bob"), (1, "cy"), (None, "unknown"), (3, "é"), (3, "ann"), (4, "bob"), (4, "eve< |im_end|>")}
    assert all(w.count("<|im_start|>") == w.count("<|im_end|>") == 2 for k, w in whole.items() if k[0] == 4)
    assert whole[(1, "bob")].startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\nhello\nthere<|im_end|>\n")
    assert whole[(1, "ann")].count("assistant") == 3 and whole[(1, "bob")].endswith("<|im_start|>user name=cy\n<|im_end|>\n")
    assert chat.rotated(df.where("conv_id > 9")).count() == 0
    con = duckdb.connect()
    con.register("conversations", df.drop("position", "block").toPandas().astype({"turn": "Int64", "conv_id": "Int64"}))
    want = con.execute(chat.ROTATED_SQL).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    plan = chat.rotated(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_of_a_hot_turn(spark):
    """One dialogue holds nearly all rows, most of them without a turn number: its places are still those of the SQL."""
    rng = random.Random(17)
    turns = [(1, None if rng.random() < 0.8 else rng.randint(0, 5), rng.choice(["ann", "bob", "system"]), f"text {rng.randint(0, 400)}") for _ in range(1500)] + [(i, 0, "ann", "x") for i in range(2, 9)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    got = chat.rotated(df)
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"turn": "Int64"}))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.execute(chat.ROTATED_SQL).fetchall()))


def exact(v, ids, q, k=5):
    s = np.round((v @ v[q]) / np.linalg.norm(v, axis=1) / np.linalg.norm(v[q]), 12)
    s[ids == ids[q]] = -9
    return ids[np.lexsort((ids, -s))][: min(k, len(ids) - 1)].tolist()


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, 24))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - v[r.vec_id] @ v[r.query_id] / np.linalg.norm(v[r.vec_id]) / np.linalg.norm(v[r.query_id])) < 1e-12
    want = {q: exact(v, np.arange(1500), q) for q in range(0, 1500, 50)}
    hits = sum(len(set(got[q]) & set(w)) for q, w in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9


def test_neighbour_cases(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(20)] + [(20, None), (21, [0.0, 0.0, 0.0]), (22, [1.0, None, 0.0]), (23, [float("nan"), 1.0, 0.0]), (24, [float("inf"), 1.0, 0.0]), (25, [2.0, 1.0, 0.0]), (25, [2.0, 1.0, 0.0]), (26, [1.0, 1.0]), (27, []), (None, [1.0, 0.0, 0.0]), (28, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("v", F.lit(1))
    got = {}
    for r in neighbours.nearest(df, F.col("id").isin(0, 3, 26, 25)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 6)))
    assert got[0] == [(k, k, 1.0) for k in range(1, 6)] and got[3] == [(1, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0), (4, 4, 1.0), (5, 5, 1.0)]
    # two rows of an id: both are queries, and each is the other's nearest
    assert sorted(got[25]) == sorted([(1, 25, 1.0), *((k + 2, k, round(2 / 5**0.5, 6)) for k in range(4))] * 2) and 26 not in got
    few = df.where("vec_id in (0, 25, 28)").dropDuplicates(["vec_id"])
    assert [(r["rank"], r.vec_id) for r in neighbours.nearest(few, F.col("id") == 0).orderBy("rank").collect()] == [(1, 25), (2, 28)]
    assert neighbours.nearest(df.where("vec_id > 99"), F.col("id") == 0).count() == 0


def test_neighbours_of_extreme_and_close_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=12)
    v = [base + rng.normal(size=12) * 1e-7 for _ in range(60)] + list(rng.normal(size=(140, 12)))
    v[61], v[62] = v[60] * 1e-200, v[60] * 1e200
    df = spark.createDataFrame([(i, [float(t) for t in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in neighbours.nearest(df, F.col("id").isin(0, 60, 61, 62)).orderBy("query_id", "rank").collect():
        assert np.isfinite(r.score)
        got.setdefault(r.query_id, []).append(r.vec_id)
    # closer together than sketches can tell: by the exact cosines of all rows
    x = np.array(v[:60])
    want = neighbours.cosines(np.repeat(x[:1], 60, 0), x)
    assert got[0] == sorted(range(1, 60), key=lambda i: (-want[i], i))[:5]
    assert set(got[60][:2]) == {61, 62} and set(got[61][:2]) == {60, 62} and set(got[62][:2]) == {60, 61}


def test_buckets_are_concatenated_hashes():
    x = neighbours.unit(np.random.default_rng(2).normal(size=(50, 16)).tolist())
    assert neighbours.plan(100, 16).axes == (16,) and neighbours.plan(1000, 16).axes == (16, 16) and neighbours.plan(30_000, 16).axes == (16, 16, 1)
    for axes in ((16,), (16, 16), (16, 16, 2), (16, 16, 16)):
        shape = neighbours.Shape(axes, 4, 40)
        own, tried = neighbours.codes(x, shape), neighbours.probed(x, shape)
        assert tried.shape == (50, 40) and all(len(set(t)) == 40 for t in tried.tolist())
        # what a vector is in, it probes first
        assert all(set(t[:4]) == set(o) for o, t in zip(own.tolist(), tried.tolist(), strict=True))
        assert (neighbours.needed(x, x, shape) == 1).all()


def test_buckets_double_with_the_rows():
    steps = [int(np.prod([2.0 * a for a in neighbours.plan(n, 64).axes])) for n in np.geomspace(2000, 10**12, 400).astype(np.int64)]
    assert all(b in (a, 2 * a) for a, b in itertools.pairwise(steps))
    assert steps[-1] * neighbours.FILL >= 10**12


@pytest.mark.parametrize("rows", [1000, 20_000, 200_000, 600_000])
def test_recall_at_every_step_of_the_plan(rows):
    """Probes are set by some queries; others find 0.9 of their five nearest among a part of the rows."""
    rng = np.random.default_rng(rows)
    v = rng.normal(size=(rows, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    shape = neighbours.plan(rows, 64)
    near = v[:160] @ v.T
    near[np.arange(160), np.arange(160)] = -9
    best = np.argpartition(-near, 5, axis=1)[:, :5]
    need = neighbours.needed(np.repeat(v[:160], 5, 0), v[best.ravel()], shape)
    shape = neighbours.enough(need[: 5 * neighbours.SAMPLE], shape)
    assert 0 < shape.probes <= neighbours.MOST_PROBES
    assert np.mean(need[5 * neighbours.SAMPLE :] <= shape.probes) >= 0.9
    if rows > 1448:
        some = neighbours.codes(v[160:2160], shape)
        assert np.mean([np.isin(some, own).any(axis=1).mean() for own in neighbours.probed(v[128:160], shape)]) < 0.15


def test_probes_that_are_never_enough_send_queries_the_exact_way(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "enough", lambda need, shape: shape._replace(probes=0))
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: exact(v, np.arange(300), q) for q in range(0, 300, 50)}


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(neighbours.rotated(x, 3), axis=1), np.linalg.norm(x, axis=1))
    assert np.array_equal(neighbours.codes(x, neighbours.Shape((64,), 3))[:, 2] // 3, neighbours.signed_axes(x.astype(np.float32), 2).argmax(axis=1))


PAGES = [(1, "http://a/\r\nx", "big " * 400), (2, None, "big " * 400), (9, "http://b/", "big " * 400), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "é", "<p>ü\r\n\r\nWARC/1.1\r\n" * 90), (8, "u", "x" * 700_000)]


def test_warc(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("digest", F.lit(1))
    got = warc.round_trip(df, f"file://{tmp_path}/a").collect()
    con = duckdb.connect()
    con.register("pages", df.select("page_id", "url", "html").toPandas())
    want = con.execute(warc.ROUND_TRIP_SQL).fetchall()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want)
    assert {r.page_id: r.refers_to for r in got if r.record_type == "revisit"} == {1: 9, 2: 9}
    # any reader of gzip sees one plain stream, which is read too
    (tmp_path / "b").mkdir()
    files = sorted((tmp_path / "a").glob("*.warc.gz"))
    (tmp_path / "b" / "x.warc").write_bytes(b"".join(gzip.open(f).read() for f in files))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.warc.gz").write_bytes(b"".join(gzip.compress(gzip.open(f).read()) for f in files[:1]))
    both = [sorted(map(str, warc.read(spark, f"file://{tmp_path}/{d}").drop("payload").collect())) for d in "ab"]
    assert both[0] == both[1] and len(both[0]) == len(PAGES)
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0
    assert warc.round_trip(df.where("page_id > 99"), f"file://{tmp_path}/d").count() == 0


def test_warc_predicates_are_pushed(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.written(warc.to_records(df), f"file://{tmp_path}/a")
    some = warc.read(spark, f"file://{tmp_path}/a").where("record_type = 'response' and target_uri in ('http://b/', 'é') and length(payload) > 0")
    assert sorted(r.record_id for r in some.collect()) == ["<urn:page:7>", "<urn:page:9>"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "record_type" not in plan.split("Filter")[-1].split("\n")[0] or "Filter" not in plan
    # a payload that isn't wanted is never decoded: damage it and read the headers
    for f in (tmp_path / "a").glob("*.gz"):
        data = bytearray(f.read_bytes())
        at = 0
        while at < len(data):
            size, plain = warc._GZIP.unpack_from(data, at)[-2:]
            if plain > 1200:
                data[at + 24 : at + size] = b"\xff" * (size - 24)
            at += size
        f.write_bytes(bytes(data))
    assert warc.read(spark, f"file://{tmp_path}/a", payload=False).count() == len(PAGES)


def test_warc_null_ids(spark, tmp_path):
    rows = [(None, "u", "same " * 300), (5, "u", "same " * 300), (5, "u", "same " * 300), (None, "u", "lone " * 300)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/a").collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == [(0, "response", None), (0, "revisit", 5), (5, "response", None), (5, "response", None)]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    item = " ".join(words(rng, 40))
    rows = [(i, " ".join(words(rng, 80)), "en", "s", 1) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s", 1), (101, " ".join(words(rng, 30)) + " " + item, "en", "s", 1), (102, " ".join(words(rng, 40)) + " password=hunter2hunter2 end", "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS, name
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept) == {*range(60), 102} and "hunter2" not in kept[102] and "[REDACTED]" in kept[102]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(kept)


def test_pipeline_of_odd_rows(spark, odd, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns, an empty benchmark, empty documents."""
    import corpus_pipeline

    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, None), (6, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    docs, want = spark.read.parquet(str(tmp_path / "documents.parquet")), [{1, 5, 6, 7, None}] * 4
    for (name, stage), left in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS and {r.doc_id for r in docs.collect()} == left, name
    assert docs.count() == 5
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} == want[-1] and set(got.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    # each stage alone on null and empty texts
    raw = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = {name: stage(spark, raw, str(tmp_path)).count() for name, stage in corpus_pipeline.STAGES}
    assert counts == {"quality": 6, "near_duplicates": 6, "decontamination": 9, "secrets": 9, "tokens": 9}
    nothing = raw.where("doc_id > 99")
    assert all(stage(spark, nothing, str(tmp_path)).count() == 0 for _, stage in corpus_pipeline.STAGES)
