import numpy as np
import xxhash
from pyspark.sql import functions as F

from docmill.llm import registry, simhash


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x85", "\x85").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    at = list(range(len(ids)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= radius):
            at[root(int(j))] = root(i)
    low = {}
    for i, d in enumerate(ids):
        low[root(i)] = min(low.get(root(i), d), d)
    return [low[root(i)] for i in range(len(ids))]


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in docs]
    want = {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(docs, fps, brute_components([r.doc_id for r in docs], fps), strict=True)}
    got = registry.op6_simhash(spark, sf).collect()
    assert len(got) == len(docs) and {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want


def variants(spark, n=300, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    out = {int(x) for x in base}
    while len(out) < n:
        x = int(base[rng.integers(3)])
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            x ^= 1 << int(b)
        out.add(x)
    fps = sorted(out)
    return fps, spark.createDataFrame([(i, x.to_bytes(8, "little")) for i, x in enumerate(fps)], "doc_id long, fp binary")


def test_large_buckets_lose_no_link(spark):
    fps, df = variants(spark)
    want = brute_components(list(range(len(fps))), fps)
    for bucket_rows in (4096, 20):
        links = simhash.near_links(df.select("fp"), 64, 4, 6, 2, bucket_rows)
        at = {int.from_bytes(r.node, "little"): int.from_bytes(r.component, "little") for r in simhash.components(links).collect()}
        groups = {}
        for i, f in enumerate(fps):
            groups.setdefault(at.get(f, f), []).append(i)
        got = {i: min(g) for g in groups.values() for i in g}
        assert [got[i] for i in range(len(fps))] == want


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (4, "one two"), (None, "ONE two"), (5, "x " * 30000)]
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("component", F.lit(2)))
    by = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in got.collect())
    assert by == [(-1, 4), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5)]
    assert simhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows, copies = [], 0
    for d in range(40):
        text = [word() for _ in range(200)]
        rows.append((d, " ".join(text), "extra", 1))
        if d % 2:
            text[17] = word()
            rows.append((100 + d, " ".join(text), "extra", 1))
            copies += 1
    rows += [(200, None, "e", 1), (201, "", "e", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, `group` int")
    left = simhash.drop_near_copies(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == [*range(40), 200, 201]


def test_near_copies_are_those_of_the_stated_similarity(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 8))

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    rows, want = [], set()
    for d in range(160):
        text = [word() for _ in range(400)]
        other = list(text)
        n = 40 if d % 2 else 46
        other[100 : 100 + n] = [word() for _ in range(n)]
        a, b = shingles(" ".join(text)), shingles(" ".join(other))
        assert (len(a & b) / len(a | b) >= 0.8) == bool(d % 2)
        rows += [(d, " ".join(text)), (1000 + d, " ".join(other))]
        want |= {d} if d % 2 else {d, 1000 + d}
    for d in range(2000, 2010):  # one passage repeated: the same set but for a few shingles
        text = [word() for _ in range(300)]
        rows += [(d, " ".join(text)), (d + 100, " ".join(text + text[:60] * 15))]
        want.add(d)
    left = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not want - left  # nothing below 0.8 goes
    assert len(left - want) <= 3  # 90 pairs, 80 of them at exactly 0.8


def test_large_components_are_compared_whole(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    sets = []
    for i in range(60):
        own = base.copy()
        n = (0, 8, 14)[i % 3]
        own[rng.choice(100, n, replace=False)] = rng.integers(0, 2**63, n, dtype=np.uint64)
        sets.append(set(own.tolist()))
    at = list(range(60))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) / len(a | b) >= 0.8:
                at = [min(at[i], at[j]) if x in (at[i], at[j]) else x for x in at]
    want = {}
    for i, x in enumerate(at):
        want.setdefault(x, set()).add(i)
    df = spark.createDataFrame([(i, b"k", np.array(sorted(s), np.uint64).tobytes()) for i, s in enumerate(sets)], "__row long, component binary, shingles binary")
    for limits in ({}, {"group_rows": 10}, {"group_bytes": 8000}):
        got = {}
        for r in simhash.components(simhash.verified_links(df, 0.8, **limits)).collect():
            got.setdefault(r.component, set()).add(r.node)
        assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_hot_components_are_compared_with_leaders_and_others_with_all(spark):
    """Most sets are copies of one; others are linked to some of those only, or by a chain, or to none."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)

    def changed(x, n):
        out = x.copy()
        out[rng.choice(100, n, replace=False)] = rng.integers(0, 2**63, n, dtype=np.uint64)
        return out

    sets = [changed(base, 3) for _ in range(150)]
    sets += [changed(sets[int(i)], int(n)) for i, n in zip(rng.integers(0, 150, 30), rng.integers(6, 14, 30), strict=True)]
    sets += [changed(sets[150 + int(i)], 9) for i in rng.integers(0, 30, 20)]
    sets += [rng.integers(0, 2**63, 100, dtype=np.uint64) for _ in range(5)]
    sets = [set(x.tolist()) for x in sets]
    at = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) / len(a | b) >= 0.8 and at[i] != at[j]:
                low, high = sorted((at[i], at[j]))
                at = [low if x == high else x for x in at]
    df = simhash.materialise(spark.createDataFrame([(i, b"k", np.array(sorted(s), np.uint64).tobytes()) for i, s in enumerate(sets)], "__row long, component binary, shingles binary").repartition(3), "sets")
    for rows in (1000, 40, 7):
        got = {r.node: r.component for r in simhash.components(simhash.verified_links(df, 0.8, group_rows=rows)).collect()}
        assert [got.get(i, i) for i in range(len(sets))] == at
    assert len(set(at)) > 5


def test_leaders_of_hot_buckets_lose_no_link(spark):
    rng = np.random.default_rng(11)
    base, out = int(rng.integers(0, 2**62)), set()
    while len(out) < 250:
        x = base
        for b in rng.choice(64, rng.integers(0, 3) if len(out) < 200 else rng.integers(4, 9), replace=False):
            x ^= 1 << int(b)
        out.add(x)
    fps = sorted(out)
    df = spark.createDataFrame([(x.to_bytes(8, "little"),) for x in fps], "fp binary")
    want = brute_components(list(range(len(fps))), fps)
    for bucket_rows in (4096, 30):
        at = {int.from_bytes(r.node, "little"): r.component for r in simhash.components(simhash.near_links(df, 64, 4, 6, 2, bucket_rows)).collect()}
        groups = {}
        for i, f in enumerate(fps):
            groups.setdefault(at.get(f, f), []).append(i)
        got = {i: min(g) for g in groups.values() for i in g}
        assert [got[i] for i in range(len(fps))] == want
