"""Near-duplicates and decontamination next to brute force."""

import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import regex
import xxhash

from cloakspan.llm import components, decontaminate, golay, simhash_dedup


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, linked):
    label = dict.fromkeys(items)
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(items, 2):
        if linked(a, b):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: find(i) for i in label}


def test_golay_decodes_three_errors():
    rng = random.Random(0)
    for _ in range(300):
        index = rng.randrange(1 << 12)
        word = index << 11 | golay._remainder(index << 11)
        for place in rng.sample(range(23), rng.randrange(4)):
            word ^= 1 << place
        assert golay.decode(np.array([word]))[0][0] == index


def test_keys_find_every_pair_within_the_radius():
    rng = random.Random(5)
    x = np.array([rng.getrandbits(64) for _ in range(200)], dtype=np.uint64)
    for bits in (1, 2, 3):
        flips = [sum(1 << p for p in rng.sample(range(64), bits)) for _ in x]
        y = x ^ np.array(flips, dtype=np.uint64)
        row, key, filed = simhash_dedup.keys_of(x.view(np.int64))
        stored = set(zip(row[filed].tolist(), key[filed].tolist()))
        row, key, _ = simhash_dedup.keys_of(y.view(np.int64))
        assert len({r for r, k in zip(row.tolist(), key.tolist()) if (r, k) in stored}) == len(x)


def dense_fingerprints(many, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(3)]
    found = {rng.getrandbits(64) for _ in range(many // 3)}
    while len(found) < many:
        found.add(rng.choice(centres) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) % (1 << 64))
    return np.array(sorted(found), dtype=np.uint64).view(np.int64)


@pytest.mark.parametrize("cell_rows", [2_048, 8])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(simhash_dedup, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(simhash_dedup, "PLAN_LEAST", 2)
    fps = dense_fingerprints(900, cell_rows)
    near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= 3
    a, b = np.nonzero(np.triu(near, 1))
    want = dict(zip(*simhash_dedup.forest(fps[a], fps[b])))
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    rows = simhash_dedup.links(df).collect()
    got_a = np.array([r["a"] for r in rows], dtype=np.int64)
    got_b = np.array([r["b"] for r in rows], dtype=np.int64)
    assert dict(zip(*simhash_dedup.forest(got_a, got_b))) == want


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, i) for i in range(501, 560)]
    edges += [(900, 900), (1000, 1001), (1001, 1000), (None, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    assert got == {
        **{i: 0 for i in range(61)}, **{i: 500 for i in range(500, 560)}, 1000: 1000, 1001: 1000,
    }
    assert components.components(df.limit(0)).count() == 0


def near_texts():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "A b C", "a B c", "Ünïcode ÄÖ x", "ünïcode äö x"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append("\n".join(copy))
    return texts + ["long " * 30_000]


def test_near_duplicates_equal_brute_force(spark):
    rows = [(10 * i + 3, t, "x") for i, t in enumerate(near_texts())]
    rows += [(5, rows[12][1], "x"), (5, rows[12][1], "x"), (None, "one", "x"), (None, "only without id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    root = brute_components(
        range(len(rows)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3
    )
    least = {}
    for i, (doc_id, _, _) in enumerate(rows):
        ids = [x for x in (least.get(root[i]), doc_id) if x is not None]
        least[root[i]] = min(ids, default=None)
    want = [(d, f"{fps[i]:016x}", least[root[i]]) for i, (d, _, _) in enumerate(rows)]
    got = simhash_dedup.near_duplicates(df).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert simhash_dedup.near_duplicates(df.limit(0)).count() == 0


# --- decontamination ------------------------------------------------------


def words_of(text):
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def counted(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_contaminated(docs, items):
    found = {}
    for doc_id, text in docs:
        words = words_of(text)
        for item_id, item in items:
            wanted = words_of(item)
            if not words or not wanted:
                continue
            b = counted(wanted)
            for at in range(max(1, len(words) - len(wanted) + 1)):
                a = counted(words[at : at + len(wanted)])
                shared = sum((a & b).values())
                similarity = shared / (a.total() + b.total() - shared)
                if similarity >= 0.8 and similarity > found.get((doc_id, item_id), (0,))[0]:
                    found[doc_id, item_id] = (similarity, at)
    return found


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"t{i}" for i in range(60)]
    take = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [take(n) for n in (3, 5, 8, 20, 45, 45, 80, 200)]
    passages.append(["same"] * 30)
    items = [(i, " ".join(p)) for i, p in enumerate(passages)]
    items += [(90, None), (91, ""), (92, "..."), (93, items[4][1])]
    docs = [(0, None), (1, ""), (2, "—"), (3, " ".join(take(4_000)))]
    for i in range(60):
        passage = list(rng.choice(passages))
        if i % 3 == 1 and len(passage) > 40:
            passage[rng.randrange(len(passage))] = "edit"
        if i % 3 == 2:
            passage = passage[rng.randrange(3) :]
        text = " ".join(take(rng.randrange(40))) + "\n" + ", ".join(passage).upper() + ". "
        docs.append((10 + i, text + " ".join(take(rng.randrange(40)))))
    docs += [docs[-1], docs[-1], (200, items[6][1][:300]), (201, "same " * 400)]
    want = brute_contaminated(docs, items)
    documents = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n int, mark string")
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    rows = decontaminate.contaminated(documents, benchmark).collect()
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"]) for r in rows}
    assert len(rows) == len(got)
    assert set(got) == set(want)
    for key in got:
        assert got[key][0] == pytest.approx(want[key][0])
    for none in (documents.limit(0), documents):
        empty = benchmark if none is not documents else benchmark.limit(0)
        assert decontaminate.contaminated(none, empty).count() == 0


def test_no_window_at_the_limit_is_lost(spark):
    """The most words that may be replaced or cut off at an end, by item size."""
    rng = random.Random(17)
    items, docs, want = [], [], {}
    for i in range(400):
        n = rng.randrange(14, 90)
        many = n - 4
        item = [f"w{rng.randrange(5_000)}" for _ in range(n)]
        items.append((i, " ".join(item)))
        other, cut = many // 9, many // 5
        replaced = ["lead"] * 6 + item[: n - other] + [f"x{j}" for j in range(20)]
        want[3 * i, i] = (many - other) / (many + other)
        want[3 * i + 1, i] = want[3 * i + 2, i] = (many - cut) / many
        docs += [(3 * i, replaced), (3 * i + 1, item[: n - cut]), (3 * i + 2, item[cut:])]
    documents = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contaminated(documents, benchmark).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_blocks_find_every_pair_within_the_radius():
    """Two fingerprints within the radius are near in one block at least."""
    radius = decontaminate.radius_of(0.8)
    blocks = decontaminate.blocks_of(radius)
    assert len(blocks) > radius // (decontaminate.NEAR + 1)
    for word in range(decontaminate.BITS // 64):
        covered = [b for w, low, width in blocks if w == word for b in range(low, low + width)]
        assert covered == list(range(64))
    assert len(decontaminate._near_masks(10)) == 1 + 10 + 45
    # the radius against a plain sum of the binomial tail
    p = math.acos(1.6 / 1.8) / math.pi
    tail = lambda r: sum(
        math.comb(128, k) * p**k * (1 - p) ** (128 - k) for k in range(r + 1, 129)
    )
    assert tail(radius) <= 1e-6 < tail(radius - 1)
    assert decontaminate.radius_of(1.0) == 0


def test_near_pairs_equal_brute_force(spark):
    """Fingerprints and pairs next to plain Python, whatever their similarity."""
    rng = random.Random(23)
    sets = [[rng.randrange(-(2**63), 2**63) for _ in range(rng.choice([1, 2, 9, 30]))] for _ in range(60)]
    sets += [s[: -(len(s) // 4) or None] + [rng.randrange(2**63)] * (len(s) // 8) for s in sets]
    windows = spark.createDataFrame([(7, i, s) for i, s in enumerate(sets)], "n int, content long, counted array<long>")
    items = windows.selectExpr("n", "content AS item_id", "counted").where("item_id % 3 > 0")
    fps = {
        r["content"]: sum((w % 2**64) << (64 * i) for i, w in enumerate(r["fp"]))
        for r in windows.selectExpr("content", f"{decontaminate._fingerprint('counted')} AS fp").collect()
    }
    for i, s in enumerate(sets):
        hashes = [
            [r[0] % 2**64 for r in spark.createDataFrame([(x,) for x in s], "x long").selectExpr(f"xxhash64(x, {k})").collect()]
            for k in (0, 1)
        ] if i < 5 else None
        if hashes:
            want = sum(
                (2 * sum(h >> b & 1 for h in hs) > len(hs)) << (64 * k + b)
                for k, hs in enumerate(hashes) for b in range(64)
            )
            assert fps[i] == want
    radius = decontaminate.radius_of(0.8)
    want = {
        (a, b) for a in fps for b in fps if b % 3 and (fps[a] ^ fps[b]).bit_count() <= radius
    }
    got = decontaminate.near_pairs(windows, items).collect()
    assert {(r["content"], r["item_id"]) for r in got} == want and len(got) == len(want)


def test_very_long_items_take_a_moment(spark):
    long = "lorem ipsum " * 60_000
    docs = spark.createDataFrame([(1, long + "end"), (2, "lorem ipsum"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, long), (8, "a b c d e f")], "item_id long, text string")
    rows = decontaminate.contaminated(docs, items).collect()
    assert [(r["doc_id"], r["item_id"], r["similarity"]) for r in rows] == [(1, 7, 1.0)]
