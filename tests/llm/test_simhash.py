import random
import re

import numpy as np
import xxhash

from cairnlake.llm import simhash as s


def brute_print(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(fps))]


def test_golay_keys_join_words_within_two():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 20000)
    keys = s.golay_keys(x)
    assert set((keys >= 0).sum(1)) == {1, 6}
    for flips in (1, 2):
        y = x.copy()
        for k in range(len(y)):
            for b in rng.choice(23, flips, replace=False):
                y[k] ^= 1 << int(b)
        other = s.golay_keys(y)
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(keys, other, strict=True))


def test_every_pair_within_three_bits_shares_a_key():
    rng = np.random.default_rng(2)
    x = rng.integers(-(1 << 63), 1 << 63, 6000)
    y = x.copy()
    for k in range(len(y)):
        for b in rng.choice(64, k % 4, replace=False):
            y[k] ^= np.int64(np.uint64(1 << int(b)).view(np.int64))
    share = [set() for _ in x]
    for which, (who, keys) in enumerate((s.keys_of(x), s.keys_of(y))):
        for i, k in zip(who.tolist(), keys.tolist(), strict=True):
            if which == 0:
                share[i].add(k)
            elif k in share[i]:
                share[i] = {"shared"} | share[i]
    assert all("shared" in keys for keys in share)


def chain(rng, start, n):
    out = [start]
    for _ in range(n):
        x = out[-1]
        for b in rng.sample(range(64), rng.randint(1, 3)):
            x ^= 1 << b
        out.append(x)
    return out


def test_components_as_brute_force(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(100)] + chain(rng, 0, 60) + chain(rng, rng.getrandbits(64), 40)
    center = rng.getrandbits(64)
    fps += [center ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(150)]
    fps = list(dict.fromkeys(fps))
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    want = brute_components(signed, fps)
    for group in (s.GROUP, 8):
        for sample in (s.SAMPLE, 1):
            roots = {r.node: r.root for r in s.components(s.links(nodes, group, sample)).collect()}
            assert [roots.get(x, x) for x in signed] == want, (group, sample)


def test_split_hot_keys_lose_no_link(spark):
    rng = random.Random(12)
    centre = rng.getrandbits(64)
    # Many fingerprints that share the first two segments, and others at distances 1 to 4 from them.
    fps = {centre & ((1 << 46) - 1) | rng.getrandbits(18) << 46 for _ in range(150)}
    for f in list(fps):
        for bit in rng.sample(range(23, 64), rng.randint(1, 4)):
            f ^= 1 << bit
        fps.add(f)
    signed = np.array(sorted(fps), np.uint64).view(np.int64)
    nodes = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    assert len(s.hot_keys(nodes, 8, 1)) > 0
    roots = {r.node: r.root for r in s.components(s.links(nodes, 8, 1)).collect()}
    root = list(range(len(signed)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(signed)):
        for j in range(i):
            if bin(int(signed[i]) & 0xFFFFFFFFFFFFFFFF ^ int(signed[j]) & 0xFFFFFFFFFFFFFFFF).count("1") <= 3:
                root[find(i)] = find(j)
    want = {}
    for i in range(len(signed)):
        want.setdefault(find(i), []).append(int(signed[i]))
    got = {}
    for x in signed.tolist():
        got.setdefault(roots.get(x, x), []).append(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_open_bits_of_keys():
    masks = s.free_bits()
    for kind in [0, 1, 2, *range(8, 16)]:
        parts = [int(x) for x in masks[kind]]
        assert sum(bin(p).count("1") for p in parts) == bin(parts[0] | parts[1] | parts[2] | parts[3]).count("1") in (41, 46, 31, 32, 33)


def test_query(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(50)]
    base = [" ".join(rng.choices(words, k=rng.randint(0, 120))) for _ in range(60)]
    texts = [None, "", " \t", "One", "one two", "ONE two", "É é Word", "a b c", "x " * 3000] + base
    texts += [t.upper() if k % 2 else t.replace("w1 ", "w2 ", 1) for k, t in enumerate(base)]
    rows = [(len(texts) - i, t, 0) for i, t in enumerate(texts)] + [(None, "a b c", 0), (None, "nobody else", 0), (3, texts[3], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = s.near_dedup(docs).collect()
    fps = [brute_print(t) for _, t, _ in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, _, _), f, c in zip(rows, fps, brute_components([r[0] for r in rows], fps), strict=True)), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_a_very_long_text_is_read_whole(spark):
    words = [f"w{i * i % 9973}" for i in range(60_000)]
    texts = {1: " ".join(words), 2: " ".join([*words[:-1], "other"]), 3: " ".join(words[:30_000]), 4: "x" * 200_000}
    docs = spark.createDataFrame([(i, t, "e") for i, t in texts.items()], "doc_id long, text string, key string")
    got = {r.doc_id: r for r in s.near_dedup(docs).collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    assert {i: int(r.fingerprint, 16) if isinstance(r.fingerprint, str) else r.fingerprint % 2**64 for i, r in got.items()} == prints
    assert [got[i].component_id for i in texts] == brute_components(list(texts), list(prints.values()))


def test_empty_table(spark):
    assert s.near_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
