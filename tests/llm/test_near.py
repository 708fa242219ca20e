import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import repeats, simhash
from quillspark.llm.components import components
from tests.llm.brute import brute_components


def test_fingerprint_by_hand():
    text = "The quick  BROWN fox\tjumps"
    h = [xxhash.xxh64_intdigest(s, 42) for s in (b"the quick brown fox", b"quick brown fox jumps")]
    assert simhash.shingle_hashes(text).tolist() == h
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > 1)
    assert simhash.fingerprint(np.array(h, np.uint64)) == want
    assert simhash.shingle_hashes("a b").tolist() == [xxhash.xxh64_intdigest(b"a b", 42)]
    assert simhash.fingerprint(simhash.shingle_hashes(None)) == 0


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=6), st.data())
def test_stars_connect_what_links(centres, data):
    fps = list({c ^ sum(1 << b for b in data.draw(st.sets(st.integers(0, 63), max_size=6))) for c in centres for _ in range(5)})
    u, v = simhash.star_links(np.array(fps, np.uint64), 4)
    edges = {frozenset((int(a), int(b))) for a, b in zip(u, v, strict=True)}
    want = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    got = brute_components(fps, lambda a, b: frozenset((a, b)) in edges)
    assert got == want and len(u) == len(fps) - len(set(want.values()))


def test_masks_cover_every_pair():
    for distance in (4, 9):
        for spare in (1, 2, 3):
            masks = simhash.block_masks(distance, spare)
            rng = random.Random(distance)
            for _ in range(200):
                flips = sum(1 << b for b in rng.sample(range(64), distance))
                assert any(flips & m == 0 for m in masks)


def test_finer_masks_keep_every_close_pair():
    rng = random.Random(3)
    assert simhash.finer_masks(simhash.ALL_BITS, 4) == simhash.finer_masks((1 << 55) - 1, 4) == []
    for mask in (0xFFFF, 0xFF << 20, (1 << 40) - 1, (1 << 54) - 1):
        finer = simhash.finer_masks(mask, 4)
        assert all(f & mask == mask for f in finer)
        rest = [b for b in range(64) if not mask >> b & 1]
        for _ in range(100):
            flips = sum(1 << b for b in rng.sample(rest, 4))
            assert any(flips & f == 0 and f != mask for f in finer)


@pytest.mark.parametrize("most", [20, 10**6])
def test_hot_buckets_are_split(spark, most):
    rng = random.Random(most)
    base = [rng.getrandbits(64) for _ in range(3)]
    # many fingerprints that agree on half their bits, near and far from each other
    fps = sorted({(b & 0xFFFFFFFF) | (rng.getrandbits(32) << 32 if rng.random() < 0.6 else (b >> 32 ^ 1 << rng.randrange(32)) << 32) for b in base for _ in range(70)})
    fps += [fps[0] ^ (1 << k) ^ (1 << j) for k in range(0, 64, 5) for j in range(1, 64, 9)]
    fps = sorted(set(fps))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r["fp"]: r["root"] for r in simhash.near_components(rows, most=most).collect()}
    want = brute_components(sorted(signed(f) for f in fps), lambda a, b: ((a ^ b) & simhash.ALL_BITS).bit_count() <= 4)
    assert got == {n: r for n, r in want.items() if n != r}


def near_rows():
    rng = random.Random(5)
    vocabulary = ["w%d" % k for k in range(50)]
    base = [[rng.choice(vocabulary) for _ in range(n)] for n in (400, 300, 3, 1, 60)]
    rows = []
    for words in base:
        for k in range(6):
            copy = list(words)
            for _ in range(min(k, 2)):
                copy[rng.randrange(len(copy))] = "edit%d" % rng.randrange(99)
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    return rows + [(500, None), (501, ""), (502, " \n"), (4, rows[0][1]), (4, rows[0][1])]


def test_simhash_against_brute_force(docs):
    rows = near_rows()
    fps = {i: simhash.fingerprint(simhash.shingle_hashes(t)) for i, t in rows}
    by_fp = brute_components(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    group = {i: min(j for j in fps if by_fp[fps[j]] == by_fp[fps[i]]) for i in fps}
    got = simhash.near_duplicates(docs(rows, extra=True)).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((i, f"{fps[i]:016x}", group[i]) for i, _ in rows)
    assert simhash.near_duplicates(docs([])).count() == 0


def test_one_of_each_group_stays(docs):
    rows = near_rows()
    full = docs(rows, extra=True)
    kept = simhash.one_of_each(full)
    assert kept.columns == full.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert len(ids) == len(set(ids)) and 500 in ids and 501 not in ids and 502 not in ids
    texts = dict(rows)
    five = lambda t: {tuple(t.split()[k : k + 5]) for k in range(max(len(t.split()) - 4, 1))} if t and t.split() else set()
    for i, t in rows:
        close = [j for j in ids if texts[j] == t or (five(t) and len(five(t) & five(texts[j])) >= 0.6 * len(five(t) | five(texts[j])))]
        assert close or not five(t)
    assert simhash.one_of_each(docs([])).count() == 0


def test_very_long_texts(docs):
    rng = random.Random(12)
    words = ["w%d" % rng.randrange(5000) for _ in range(200_000)]
    other = list(words)
    other[1000:1003] = ["x", "y", "z"]
    rows = [(1, " ".join(words)), (2, "\t".join(other)), (3, " ".join(words[:100_000])), (4, "x" * 1_500_000)]
    ones = np.zeros(64, np.int64)
    for k in range(len(words) - 3):
        h = xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42)
        ones += np.array([h >> b & 1 for b in range(64)]) if k % 50 == 0 else 0  # every fiftieth by hand
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(rows)).collect()}
    hashes = simhash.shingle_hashes(rows[0][1])
    assert len(hashes) == len(words) - 3
    assert (np.unpackbits(hashes[::50].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0) == ones).all()
    assert got[1]["fingerprint"] == f"{simhash.fingerprint(hashes):016x}" and got[2]["component_id"] == 1 and got[4]["component_id"] == 4
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs(rows)).collect()) == [1, 3, 4]


@pytest.mark.parametrize("most", [512, 3])
def test_one_of_each_is_decided_by_jaccard(docs, most):
    rng = random.Random(11)
    words = lambda n: ["v%d" % rng.randrange(10**6) for _ in range(n)]
    texts = []
    for _ in range(60):
        # sets of a and b words' shingles that share ``both``: similarities on either side of 0.8
        base, cut = words(rng.randrange(60, 400)), rng.uniform(0.70, 0.92)
        texts += [base, base[: round(len(base) * cut)] + words(rng.randrange(0, 3))]
    chain = words(300)
    texts += [chain[k * 20 :] + words(20 * k) for k in range(6)]
    texts += [words(4), [], words(3)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = {k: {tuple(t[i : i + 5]) for i in range(max(len(t) - 4, 1))} if t else set() for k, t in enumerate(texts)}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    pairs = [(a, b) for a in sets for b in sets if a < b and near(a, b)]
    assert 15 < len(pairs) < 120
    group = brute_components(sorted(sets), near)
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs(rows), most=most).collect()) == sorted(set(group.values()))


def test_a_large_group_of_near_copies(docs):
    rng = random.Random(8)
    base = ["b%d" % k for k in range(120)]
    texts = []
    for k in range(60):
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(120)] = "e%d" % rng.randrange(999)
        texts.append(copy)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = {k: {tuple(t[i : i + 5]) for i in range(len(t) - 4)} for k, t in enumerate(texts)}
    group = brute_components(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert 20 < len(set(group.values())) < 30
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs(rows), most=7).collect()) == sorted(set(group.values()))


def some_hashes(rng, n):
    return rng.integers(0, 2**64, n, dtype=np.uint64)


def test_long_fingerprint_by_hand():
    rng = np.random.default_rng(6)
    for n in (1, 2, 4, 9, 255, 256, 600):
        hashes = np.unique(some_hashes(rng, n))
        with np.errstate(over="ignore"):
            words = [[int(x) for x in simhash.second_hashes(hashes + step)] for step in simhash.STEPS]
        ones = lambda w, b: sum(x >> b & 1 for x in w)
        want = sum(1 << 64 * k + b for k, w in enumerate(words) for b in range(64) if 2 * ones(w, b) > n or (2 * ones(w, b) == n and w[0] >> b & 1))
        assert int.from_bytes(simhash.long_fingerprint(hashes), "little") == want
    assert simhash.long_fingerprint(np.empty(0, np.uint64)) == bytes(8 * simhash.WORDS)


@pytest.mark.parametrize("short", [True, False])
@pytest.mark.parametrize("count", [10, 200_000, 10_000_000])
def test_blocks_and_distance_find_pairs_at_the_least_similarity(count, short):
    rng = np.random.default_rng(count)
    share = simhash.differing(0.8, short)
    plan, by = simhash.block_plan(share, count, 42), simhash.ByBits.at(share)
    deal = plan.ravel()[: 64 * simhash.WORDS]
    assert len(set(deal.tolist())) == len(deal)
    assert (1 - (1 - share) ** plan.shape[1]) ** len(plan) <= simhash.MISS
    apart = []
    for k in range(1500):
        # 8 shared of 8 and 10, and 8 of 9 and 9, with larger sets in proportion: a similarity of 0.8
        n = 1 + k % 7 if short else 8 + k % 30
        shared, a, b = some_hashes(rng, 8 * n), some_hashes(rng, n * (k % 2)), some_hashes(rng, n * (2 - k % 2))
        one, other = (np.frombuffer(simhash.long_fingerprint(np.sort(np.concatenate([shared, x]))), "<u8") for x in (a, b))
        bits = np.unpackbits((one ^ other).view(np.uint8), bitorder="little")
        assert not bits[plan].any(axis=1).all() and len(by.pairs(one[None], other[None])[0]) == 1
        apart.append(bits.mean())
    assert 0.13 < np.mean(apart) < share


@pytest.mark.parametrize("most", [10**6, 9])
def test_stage_candidates_are_linked_by_fingerprints(spark, most):
    rng = np.random.default_rng(9)
    prints = []
    for _ in range(12):
        base = some_hashes(rng, simhash.WORDS)
        for k in range(9):
            flips = np.packbits(rng.random(64 * simhash.WORDS) < 0.05 * k, bitorder="little").view("<u8")
            prints.append(base ^ flips)
    prints += prints[:3]
    rows = spark.createDataFrame([(bytearray(p.tobytes()),) for p in prints], "print binary")
    tables = []
    share = simhash.differing(0.8, short=False)
    links = simhash.fingerprint_links(rows, share, 42, most, tables)
    got = {bytes(r["node"]): bytes(r["root"]) for r in components(links).collect()}
    plan, far = simhash.block_plan(share, len(prints) - 3, 42), simhash.ByBits.at(share).far
    bits = [np.unpackbits(p.view(np.uint8), bitorder="little") for p in prints]
    width = 64 * simhash.CHECKED
    near = lambda a, b: (bits[a][:width] != bits[b][:width]).sum() <= far and (bits[a][plan] == bits[b][plan]).all(axis=1).any()
    group = brute_components(list(range(len(prints))), near)
    heads = [p[: simhash.CHECKED].tobytes() for p in prints]
    least = {}
    for k, g in group.items():
        least[g] = min(least.get(g, heads[k]), heads[k])
    want = {heads[k]: least[g] for k, g in group.items() if heads[k] != least[g]}
    assert got == want and 12 <= len(set(group.values())) < 100


def test_hot_fingerprint_buckets_lose_no_text(docs):
    rng = random.Random(21)
    base = ["b%d" % k for k in range(150)]
    texts = [[w if rng.random() > 0.01 * (k % 3) else "e%d" % rng.randrange(999) for w in base] for k in range(50)]
    texts += [["c%d_%d" % (k, j) for j in range(40)] for k in range(20)] + [[]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    tuples = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    want = brute_components(list(range(len(rows))), lambda a, b: bool(tuples[a]) and len(tuples[a] & tuples[b]) >= 0.8 * len(tuples[a] | tuples[b]))
    sets = simhash.shingle_sets(docs(rows), 5, 42).cache()
    ids = {r["doc_id"]: bytes(r["id"]) for r in sets.collect()}
    for bucket in (10**6, 4):
        root = {bytes(r["id"]): bytes(r["root"]) for r in simhash.similar_components(sets, 5, 0.8, 42, most=6, bucket=bucket).collect()}
        got = [root.get(ids[k], ids[k]) for k in range(len(rows))]
        same = lambda names: {frozenset(k for k, m in enumerate(names) if m == n) for n in names}
        assert same(got) == same([want[k] for k in range(len(rows))])
    sets.unpersist()


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=30))
def test_components_against_brute_force(spark, links):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long"), salts=3).collect()}
    nodes = sorted({n for link in links for n in link})
    want = brute_components(nodes, lambda a, b: (a, b) in links or (b, a) in links)
    assert got == {n: r for n, r in want.items() if n != r}


def test_intervals_of_a_suffix_array():
    text = "mississippi"
    order = sorted(range(len(text)), key=lambda k: text[k:])
    common = [next((n for n in range(99) if text[a + n : a + n + 1] != text[b + n : b + n + 1] or not text[a + n : a + n + 1]), 0) for a, b in zip(order, order[1:], strict=False)]
    found = {(text[order[i] : order[i] + n], j - i + 1) for n, i, j in repeats.intervals(np.array(common))}
    assert found == {("issi", 2), ("i", 4), ("p", 2), ("ssi", 2), ("si", 2), ("s", 4)}


def brute_repeats(rows, length):
    count = Counter()
    datas = [(i, (t or "").encode()) for i, t in rows]
    for _, d in datas:
        count.update(d[s : s + length] for s in range(len(d) - length + 1))
    out = []
    for i, d in datas:
        hit = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if count[d[s : s + length]] > 1:
                hit[s : s + length] = b"\x01" * length
        spans = sum(1 for k in range(len(d)) if hit[k] and not (k and hit[k - 1]))
        out.append((i, len(d), sum(hit), spans, hashlib.sha256(bytes(b for k, b in enumerate(d) if not hit[k])).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [1024, 9])
def test_repeats_against_brute_force(docs, sample, most):
    rng = random.Random(most)
    rows = [(r["doc_id"], r["text"][:2000]) for r in sample[:60]]
    passage = sample[3]["text"][:900]
    for k in range(40):
        other = rng.choice(rows)[1]
        a, b = rng.randrange(200), rng.randrange(300, 900)
        rows.append((1000 + k, other[: rng.randrange(400)] + passage[a:b] + other[400 : 400 + rng.randrange(300)]))
    rows += [(2000, None), (2001, ""), (2002, "a" * 450), (2003, "ab" * 300), (2004, rows[7][1]), (2005, "x" * 199), (2006, "é" * 150), (None, rows[9][1]), (2007, rows[9][1]), (2007, rows[9][1])]
    got = repeats.repeats(docs(rows, extra=True), most=most).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_repeats(rows, 200)


@pytest.mark.parametrize("most", [1024, 5])
def test_repeat_groups_against_brute_force(docs, most):
    rng = random.Random(most)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    p, q, r = noise(230), noise(400), noise(215)
    texts = [noise(50) + p + noise(30), p + noise(260), noise(10) + p, noise(5) + q + noise(99) + p[20:], q[30:] + noise(9), noise(300), r, r, "x" + r, None, ""]
    texts += [noise(3) + p[:215] + noise(4) for _ in range(9)] + ["ab" * 130]
    got = {}
    for g in repeats.repeat_groups(docs(list(enumerate(texts)), extra=True), most=most).collect():
        got.setdefault((g["group_id"], g["length"]), set()).add((g["doc_id"], g["start"]))
    datas = [(t or "").encode() for t in texts]
    covered = [bytearray(len(d)) for d in datas]
    for (_, n), spots in got.items():
        doc, start = min(spots)
        content = datas[doc][start : start + n]
        want = {(k, s) for k, d in enumerate(datas) for s in range(len(d) - n + 1) if d[s : s + n] == content}
        assert spots == want and len(spots) > 1 and n >= 200
        for k, s in spots:
            covered[k][s : s + n] = b"\x01" * n
    want = {r[0]: r[2] for r in brute_repeats(list(enumerate(texts)), 200)}
    assert {k: sum(c) for k, c in enumerate(covered)} == want
    assert repeats.repeat_groups(docs([])).count() == 0


def test_maximal_repeats_of_a_tree(docs):
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    p = noise(210)
    # the passage four times, twice with the same bytes before and after it
    texts = ["1L" + p + "R4" + noise(40), noise(20) + "2L" + p + "R5", noise(9) + "M" + p + "S", "N" + p + "R6" + noise(3)]
    lengths = {}
    for g in repeats.repeat_groups(docs(list(enumerate(texts)))).collect():
        lengths.setdefault((g["group_id"], g["length"]), set()).add(g["doc_id"])
    sets = {(n, frozenset(d)) for (_, n), d in lengths.items()}
    assert {x for x in sets if x[0] >= 210} <= {(212, frozenset({0, 1})), (211, frozenset({0, 1, 3})), (210, frozenset({0, 1, 2, 3}))}
    assert max(n for n, _ in sets) >= 200


def test_repeats_in_a_very_long_text(docs):
    rng = random.Random(4)
    p = "".join(rng.choice("abcdefgh ") for _ in range(300))
    long = " ".join("%x" % rng.getrandbits(40) for _ in range(100_000))
    rows = [(1, long + p + long[:50]), (2, p + "z"), (3, long[500_000:500_260])]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeats.repeats(docs(rows)).collect()}
    assert got == {1: (len(long) + 350, 560, 2), 2: (301, 300, 1), 3: (260, 260, 1)}


def test_repeats_across_chunks(docs, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 500)
    rng = random.Random(1)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p = noise(260)
    texts = [noise(1300) + p + noise(900), noise(40) + p + noise(2100), noise(3000)]
    for t in texts:
        for (place, gram, context), part in ((repeats.anchors(t.encode()), t.encode()),):
            assert len(place) and len(place) == len(gram) == len(context)
    shared = set(repeats.anchors(texts[0].encode())[1]) & set(repeats.anchors(texts[1].encode())[1])
    assert shared
    monkeypatch.setattr(repeats, "CHUNK", 1 << 20)
    assert [x.tolist() for x in repeats.anchors(texts[0].encode())] == [x.tolist() for x in _chunked(texts[0].encode())]


def _chunked(data):
    repeats.CHUNK, before = 500, repeats.CHUNK
    try:
        return repeats.anchors(data)
    finally:
        repeats.CHUNK = before


def test_repeats_of_nothing(docs):
    assert repeats.repeats(docs([])).count() == 0
