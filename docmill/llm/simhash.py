"""SimHash near-dedup: fingerprints, pigeonhole blocks, Hamming check, components.

A fingerprint of ``bits`` bits is cut into ``blocks`` blocks. Two fingerprints that differ in at
most ``radius`` bits agree on at least blocks - radius whole blocks, so with ``agree`` of those
the join on every choice of ``agree`` blocks loses no pair (agree <= blocks - radius). Members of a
bucket are compared in sorted order, batch by batch; a bucket emits at most one link per member
and batch, never all its pairs. In a bucket above ``bucket_rows`` members, most of which are copies
of one text as a rule, every member is first compared with a few of them, the leaders. Members
linked to the leader that has most are one group already; only the others are compared with all,
chunk by chunk, so no task holds more than two chunks and a hot text costs no square of its copies.

The pipeline's near copies take such links, of wide fingerprints and a generous radius, as
candidates only: what decides is the Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, pi

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.plans.components import components
from docmill.plans.shared import join_checked, materialise

SEED = 42
#: Shingle hashes whose bits are counted at once.
STEP = 1 << 14
#: Bytes of a wide fingerprint that name it and that the Hamming check of candidates compares.
NODE = 32


def _spread(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64-bit word of a wider hash: the hash itself, then mixed with odd constants."""
    if k == 0:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int = 4) -> np.ndarray:
    """64-bit hashes of text's word shingles in order, repeats included.

    Words are runs without white space [\\x20\\x09-\\x0D] after lower-casing A-Z; a text of fewer
    words is one shingle; a null or wordless text has none.
    """
    w = (text or "").encode().lower().split()
    shingles = zip(*(w[i:] for i in range(shingle)), strict=False) if len(w) >= shingle else [w] if w else []
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles), np.uint64)


def fingerprint(text: str | None, shingle: int = 4, words: int = 1, distinct: bool = False) -> bytes:
    """The SimHash of text's word shingles: words x 8 bytes, little-endian.

    Repeated shingles count as often as they occur, with ``distinct`` once. A null or wordless
    text has fingerprint zero.
    """
    h = shingle_hashes(text, shingle)
    if not len(h):
        return bytes(8 * words)
    if distinct:
        h = np.unique(h)
    out = np.zeros(words, np.uint64)
    for k in range(words):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(h), STEP):
            ones += np.unpackbits(_spread(h[i : i + STEP], k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return out.tobytes()


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1, row: str | None = None, distinct: bool = False) -> DataFrame:
    """(__row, doc_id, fp) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle, words, distinct) for t in b["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([b["__row"], b["doc_id"], fps], names=["__row", "doc_id", "fp"])

    own = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("__row"), "doc_id", "text")
    return own.mapInArrow(run, f"__row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp binary")


def _edges(bits: int, blocks: int) -> list[int]:
    return [round(i * bits / blocks) for i in range(blocks + 1)]


def _keyed(fps: DataFrame, bits: int, blocks: int, agree: int) -> DataFrame:
    """(slot, key, fp): each fingerprint under every choice of ``agree`` blocks."""
    cuts, picks = _edges(bits, blocks), list(combinations(range(blocks), agree))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            on = np.unpackbits(np.frombuffer(b"".join(b["fp"]), np.uint8).reshape(len(b), -1), axis=1, bitorder="little").astype(np.uint64)
            block = [on[:, i:j] @ (np.uint64(1) << np.arange(j - i, dtype=np.uint64)) for i, j in zip(cuts, cuts[1:], strict=False)]
            for slot, pick in enumerate(picks):
                key = np.zeros(len(b), np.uint64)
                for i in pick:
                    key = (key << np.uint64(cuts[i + 1] - cuts[i])) | block[i]
                yield pd.DataFrame({"slot": np.int32(slot), "key": key.view(np.int64), "fp": b["fp"]})

    if max((j - i for i, j in zip(cuts, cuts[1:], strict=False)), default=0) * agree > 63:
        raise ValueError("the blocks of one key must fit 63 bits")
    return fps.select("fp").mapInPandas(run, "slot int, key long, fp binary")


def _drawn(fps: DataFrame, bits: int, blocks: int, width: int) -> DataFrame:
    """(slot, key, fp): the first NODE bytes of each fingerprint under ``blocks`` drawn choices of ``width`` bits.

    Every bits // width choices share no bit, so a few of them repeat a bit only as often as they must.
    """
    rng = np.random.default_rng(SEED)
    picks = np.concatenate([rng.permutation(bits)[: bits // width * width].reshape(-1, width) for _ in range(ceil(blocks / (bits // width)))])[:blocks]
    weights = np.uint64(1) << np.arange(width, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            on = np.unpackbits(np.frombuffer(b"".join(b["fp"]), np.uint8).reshape(len(b), -1), axis=1, bitorder="little").astype(np.uint64)
            node = b["fp"].str.slice(0, NODE)
            for slot, pick in enumerate(picks):
                yield pd.DataFrame({"slot": np.int32(slot), "key": (on[:, pick] @ weights).view(np.int64), "fp": node})

    return fps.select("fp").mapInPandas(run, "slot int, key long, fp binary")


def _near(m: np.ndarray, group: np.ndarray, radius: int, joined: np.ndarray | None = None) -> np.ndarray:
    """Smallest row that each row of m reaches by links within its group; rows are sorted by group, those of a group in ``joined`` are linked."""
    low = np.arange(len(m))
    if joined is not None and joined.any():
        first = np.full(group[-1] + 1, len(m))
        np.minimum.at(first, group[joined], low[joined])
        low[joined] = first[group[joined]]
    lag, alive = 1, np.arange(len(m) - 1)
    while len(alive):
        alive = alive[alive + lag < len(m)]
        alive = alive[group[alive] == group[alive + lag]]
        apart = alive[low[alive] != low[alive + lag]]
        near = apart[np.bitwise_count(m[apart] ^ m[apart + lag]).sum(1) <= radius]
        one, two = low[near], low[near + lag]
        while len(apart := np.flatnonzero(one != two)):
            np.minimum.at(low, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
            while (low != low[low]).any():
                low = low[low]
            one, two = low[near], low[near + lag]
        lag += 1
    return low


def _words(fps: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(fps), np.uint64).reshape(len(fps), -1)


def _linked(keyed: DataFrame, group: list[str], radius: int, bucket_rows: int | None, leaders: int = 8) -> DataFrame:
    """(a, b, slot, key, near): links inside groups; with bucket_rows, b is null for a member of a larger group.

    near: bits of the leaders of the larger group that the member is linked to; those links are
    given too. Without bucket_rows the column main tells members that are linked already. The
    rows of a group reach one task sorted; it holds one batch and the group at its end.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(rows: pd.DataFrame) -> pd.DataFrame:
            low = _near(_words(rows["fp"]), rows.groupby(group, sort=False).ngroup().to_numpy(), radius, rows["main"].to_numpy() if "main" in rows else None)
            at = np.flatnonzero(low != np.arange(len(rows)))
            fp = rows["fp"].to_numpy()
            return pd.DataFrame({"a": fp[at], "b": fp[low[at]], "slot": np.int32(0), "key": np.int64(0), "near": np.int32(0)})

        def lead(rows: pd.DataFrame) -> tuple[tuple, pd.Series, np.ndarray]:
            """Of a large group: its key, some members and to which of them each of these is joined."""
            some = rows["fp"].iloc[np.unique(np.linspace(0, len(rows) - 1, leaders).astype(int))].reset_index(drop=True)
            return tuple(rows[group].iloc[0]), some, _near(_words(some), np.zeros(len(some), int), radius)

        def over(rows: pd.DataFrame, some: pd.Series, low: np.ndarray) -> Iterator[pd.DataFrame]:
            m, near = _words(rows["fp"]), np.zeros(len(rows), np.int32)
            for i, x in enumerate(_words(some)):
                hit = np.bitwise_count(m ^ x).sum(1) <= radius
                own, is_new = np.int32(1 << low[i]), near & np.int32(1 << low[i]) == 0
                yield pd.DataFrame({"a": rows["fp"].to_numpy()[hit & is_new], "b": some[i], "slot": np.int32(0), "key": np.int64(0), "near": np.int32(0)})
                near[hit] |= own
            yield pd.DataFrame({"a": rows["fp"], "b": None, "slot": rows["slot"], "key": rows["key"], "near": near})

        rest, large = pd.DataFrame(), None
        for b in batches:
            if not len(b):
                continue
            if large is not None:
                same = (b[group] == large[0]).all(axis=1)
                if same.any():
                    yield from over(b[same], *large[1:])
                b = b[~same]
                if not len(b):
                    continue
                large = None
            rows = pd.concat([rest, b], ignore_index=True) if len(rest) else b.reset_index(drop=True)
            last = (rows[group] == rows[group].iloc[-1]).all(axis=1)
            full, rest = rows[~last], rows[last]
            if bucket_rows and len(full):
                n = full.groupby(group)["fp"].transform("size")
                for _, own in full[n > bucket_rows].groupby(group):
                    yield from over(own, *lead(own)[1:])
                full = full[n <= bucket_rows]
            if len(full):
                yield done(full)
            if bucket_rows and len(rest) > bucket_rows:
                large = lead(rest)
                yield from over(rest, *large[1:])
                rest = pd.DataFrame()
        if len(rest):
            yield done(rest)

    dealt = keyed.repartition(*group).sortWithinPartitions(*group, "fp")
    return dealt.mapInPandas(run, "a binary, b binary, slot int, key long, near int")


def _main(rows: DataFrame, by: list[str], leaders: int, label: str, keep: list[str] | None) -> DataFrame:
    """(by, main, n, others): per group the bit of the leader that most rows are near to, the rows and those not near it."""
    bits = [F.sum((F.shiftright("near", i) % 2).cast("long")) for i in range(leaders)]
    most = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*bits).alias("bits"))
    most = most.select(*by, "n", F.array_max("bits").alias("most"), (F.array_position("bits", F.array_max("bits")) - 1).cast("int").alias("main"))
    return materialise(most.select(*by, "main", "n", (F.col("n") - F.col("most")).alias("others")), label, keep)


def _against_others(rows: DataFrame, by: list[str], chunks: Column, other_chunks: Column, row: str) -> DataFrame:
    """rows (by, main, row, ..) under (i, j): every one not main meets every other, in pairs of a chunk i of those and a chunk j of all."""
    rows = rows.withColumns({"__all": chunks.cast("int"), "__others": other_chunks.cast("int")})
    j, i = F.pmod(F.xxhash64(row), F.col("__all")).cast("int"), F.pmod(F.xxhash64(row, F.lit(1)), F.col("__others")).cast("int")
    places = F.transform(F.sequence(F.lit(0), F.col("__others") - 1), lambda x: F.struct(x.alias("i"), j.alias("j")))
    own = F.transform(F.sequence(F.lit(0), F.col("__all") - 1), lambda x: F.struct(i.alias("i"), x.alias("j")))
    places = F.when(F.col("main"), places).otherwise(F.array_union(places, own))
    return rows.filter("__others > 0").select("*", F.explode(places).alias("__at")).select("*", "__at.i", "__at.j").drop("__at", "__all", "__others")


def near_links(fps: DataFrame, bits: int, radius: int, blocks: int, agree: int, bucket_rows: int = 4096, keep: list[str] | None = None) -> DataFrame:
    """(a, b): links between different fingerprints that join the same ones as all pairs within radius that share ``agree`` blocks."""
    return _links(_keyed(fps, bits, blocks, agree), radius, bucket_rows, keep)


def _links(keyed: DataFrame, radius: int, bucket_rows: int, keep: list[str] | None) -> DataFrame:
    leaders = 8
    found = materialise(_linked(keyed, ["slot", "key"], radius, bucket_rows, leaders), "links", keep)
    links = found.filter("b is not null").select("a", "b")
    large = found.filter("b is null").select("slot", "key", F.col("a").alias("fp"), "near")
    if not large.isEmpty():
        sizes = _main(large, ["slot", "key"], leaders, "large", keep)
        rows = join_checked(large, sizes.filter("others > 0"), ["slot", "key"], "inner").withColumn("main", F.expr("shiftright(near, main) % 2 = 1"))
        parts = _against_others(rows, ["slot", "key"], F.ceil(F.col("n") * 2 / bucket_rows), F.ceil(F.col("others") * 2 / bucket_rows), "fp").select("slot", "key", "i", "j", "fp", "main")
        links = links.unionByName(materialise(_linked(parts, ["slot", "key", "i", "j"], radius, None), "large-links", keep).select("a", "b"))
    return links.distinct()


def near_groups(docs: DataFrame, shingle: int = 4, bits: int = 64, radius: int = 4, blocks: int = 6, agree: int = 2, bucket_rows: int = 4096, row: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): __row, doc_id, fp and component_id.

    component_id: the smallest doc_id reachable by links, the row's own included; rows of equal
    fingerprints are linked, also those of empty texts. A null doc_id counts only where a
    component has no other. Empty table: no rows. Repeated rows are linked like any; there are no
    ties. A very long text is hashed by one task, its bits counted STEP shingles at a time.
    """
    rows = materialise(fingerprints(docs, shingle, bits // 64, row), "fingerprints", keep)
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(near_links(distinct, bits, radius, blocks, agree, bucket_rows, keep), keep)
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialise(named, "named", keep)
    ids = materialise(named.groupBy("component").agg(F.min("first").alias("component_id")), "component-ids", keep)  # else AQE can't split a hot component
    return rows.join(named.join(ids, "component").select("fp", "component_id", "component"), "fp").select("__row", "doc_id", "fp", "component_id", "component")


def similarity_radius(similarity: float, bits: int, slack: float = 1.0) -> int:
    """Differing bits of fingerprints of two shingle sets with this Jaccard similarity.

    Equal-sized sets have cosine 2s / (1 + s), and a bit differs with probability angle / pi;
    slack: so many standard deviations above the mean still link.
    """
    p = acos(2 * similarity / (1 + similarity)) / pi
    return ceil(bits * p + slack * (bits * p * (1 - p)) ** 0.5)


def _shared(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the sets, where each begins, and their members as small integers, one set after the other."""
    size = np.array([len(x) for x in sets])
    return size, np.concatenate([[0], np.cumsum(size)]), np.unique(np.concatenate(sets), return_inverse=True)[1]


def _alike(sets: list[np.ndarray], similarity: float, joined: np.ndarray | None = None) -> np.ndarray:
    """Smallest place that each of the sets, none of them empty, reaches by pairs of this Jaccard similarity or more.

    Sets in ``joined`` are joined. Every pair is compared that isn't joined by then.
    """
    size, cut, codes = _shared(sets)
    own, low = np.zeros(len(codes), np.int32), np.arange(len(sets))
    if joined is not None and joined.any():
        low[joined] = np.flatnonzero(joined)[0]
    for i in range(len(sets) - 1):
        others = i + 1 + np.flatnonzero(low[i + 1 :] != low[i])
        if not len(others):
            continue
        mine = codes[cut[i] : cut[i + 1]]
        own[mine] = 1
        if 4 * len(others) > len(sets) - i:
            shared = np.add.reduceat(own[codes[cut[i + 1] :]], cut[i + 1 : -1] - cut[i + 1])[others - i - 1]
        else:
            shared = np.array([own[codes[cut[j] : cut[j + 1]]].sum() for j in others])
        own[mine] = 0
        if len(near := others[shared / (size[others] + size[i] - shared) >= similarity]):
            roots = np.unique(np.append(low[near], low[i]))
            low[np.isin(low, roots)] = roots[0]
    return low


def _shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(__row, component, shingles) of docs (__row, component, text): the sorted distinct shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in b["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([b["__row"], b["component"], sets], names=["__row", "component", "shingles"])

    return docs.select("__row", "component", "text").mapInArrow(run, "__row long, component binary, shingles binary")


def _near_leaders(large: DataFrame, similarity: float, leaders: int, keep: list[str] | None) -> DataFrame:
    """(__row, component, near, links) of large (__row, component, shingles, share): bits of the leaders this similar, and their rows.

    Rows are dealt by component and salt, ``share`` salts to a component; its leaders go to each of
    them and come first, so a task holds one component's leaders and one batch.
    """
    nth = F.row_number().over(Window.partitionBy("component").orderBy(F.xxhash64("__row")))
    some = materialise(large.select("__row", "component").withColumn("nth", nth).filter(F.col("nth") <= leaders).select("__row", "nth"), "leaders", keep)
    salts = F.ceil("share").cast("int")
    first = join_checked(large, some, ["__row"], "inner").select("component", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "nth", "__row", "shingles")
    rows = large.select("component", F.pmod(F.xxhash64("__row"), salts).cast("int").alias("salt"), F.lit(leaders + 1).alias("nth"), "__row", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sets = None, [], []
        for b in batches:
            out: list[tuple] = []
            for component, n, row, x in zip(b["component"].to_pylist(), b["nth"].to_pylist(), b["__row"].to_pylist(), b["shingles"], strict=True):
                own = np.frombuffer(x.as_py(), np.uint64)
                if component != at:
                    at, ids, sets = component, [], []
                if n <= leaders:
                    if row not in ids:  # another salt of the component in the same task
                        ids.append(row)
                        sets.append(own)
                    continue
                shared = [len(np.intersect1d(own, y, True)) for y in sets]
                hit = [s >= similarity * (len(own) + len(y) - s) for s, y in zip(shared, sets, strict=True)]
                out.append((row, component, sum(1 << i for i, h in enumerate(hit) if h), [i for i, h in zip(ids, hit, strict=True) if h]))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            types = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["__row", "component", "near", "links"])

    dealt = rows.unionByName(first).repartition("component", "salt").sortWithinPartitions("component", "salt", "nth")
    return materialise(dealt.mapInArrow(run, "__row long, component binary, near int, links array<long>"), "near-leaders", keep)


def verified_links(sets: DataFrame, similarity: float, group_rows: int = 512, group_bytes: int = 1 << 24, keep: list[str] | None = None) -> DataFrame:
    """(a, b): links between rows of one component of sets (__row, component, shingles) that join the same ones as all pairs of this similarity or more.

    sets is a written table. In a component above group_rows rows or group_bytes of shingles, each
    row is compared with a few leaders; rows like the leader that has most are one group, and only
    the others are compared with all, in pairs of chunks, so no task holds more than two.
    """
    group, leaders = ["component", "i", "j"], 8

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(rows: pd.DataFrame) -> pd.DataFrame:
            at, ids, of, main = rows.groupby(group, sort=False).ngroup().to_numpy(), rows["__row"].to_numpy(), rows["shingles"].to_numpy(), rows["main"].to_numpy()
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1), len(rows)]
            low = np.concatenate([i + _alike([np.frombuffer(x, np.uint64) for x in of[i:j]], similarity, main[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)])
            linked = np.flatnonzero(low != np.arange(len(rows)))
            return pd.DataFrame({"a": ids[linked], "b": ids[low[linked]]})

        rest = pd.DataFrame()
        for b in batches:
            if not len(b):
                continue
            rows = pd.concat([rest, b], ignore_index=True) if len(rest) else b
            last = (rows[group] == rows[group].iloc[-1]).all(axis=1)
            if not last.all():
                yield done(rows[~last])
            rest = rows[last]
        if len(rest):
            yield done(rest)

    share = F.greatest(F.count(F.lit(1)) / F.lit(group_rows), F.sum(F.length("shingles")) / F.lit(group_bytes))
    sizes = sets.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), share.alias("share")).filter("share > 1")
    sizes = materialise(sizes, "large-components", keep)
    own = join_checked(sets, sizes, ["component"])
    groups = own.filter("share is null").select("component", F.lit(0).alias("i"), F.lit(0).alias("j"), "__row", "shingles", F.lit(False).alias("main"))
    links = None
    if not sizes.isEmpty():
        near = _near_leaders(own.filter("share is not null").select("__row", "component", "shingles", "share"), similarity, leaders, keep)
        links = near.select(F.col("__row").alias("a"), F.explode("links").alias("b")).filter("a != b")
        others = _main(near, ["component"], leaders, "large-components", keep).filter("others > 0")
        rows = join_checked(near.select("__row", "component", "near"), others, ["component"], "inner").withColumn("main", F.expr("shiftright(near, main) % 2 = 1"))
        rows = join_checked(rows, sizes.select("component", "share"), ["component"])
        chunks = F.ceil(2 * F.col("share"))
        parts = _against_others(rows, ["component"], chunks, F.ceil(chunks * F.col("others") / F.col("n")), "__row").select("component", "i", "j", "__row", "main")
        groups = groups.unionByName(sets.select("__row", "shingles").join(parts, "__row").select(*groups.columns))
    dealt = groups.repartition(*group).sortWithinPartitions(*group, "__row")
    found = dealt.mapInPandas(run, "a long, b long")
    return materialise(found if links is None else found.unionByName(links), "verified", keep)


def near_copy_groups(docs: DataFrame, shingle: int, similarity: float, bits: int, blocks: int, width: int, slack: float, keep: list[str] | None = None) -> DataFrame:
    """(__row, doc_id, component) of the rows of docs (__row, doc_id, text) that have near copies; docs has no row without a word."""
    rows = materialise(fingerprints(docs, shingle, bits // 64, "__row", distinct=True), "fingerprints", keep)
    found = components(_links(_drawn(rows.select("fp").distinct(), bits, blocks, width), similarity_radius(similarity, 8 * NODE, slack), 4096, keep), keep)
    named = rows.select("__row", F.substring("fp", 1, NODE).alias("node")).join(found, "node", "left")
    named = materialise(named.select("__row", F.coalesce("component", "node").alias("component")), "candidate-components", keep)
    several = materialise(named.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component"), "several", keep)
    asked = materialise(named.join(several, "component").select("__row", "component"), "candidates", keep)
    sets = materialise(_shingle_sets(join_checked(docs, asked, ["__row"], "inner"), shingle), "shingle-sets", keep)
    alike = components(verified_links(sets, similarity, keep=keep), keep)
    return rows.select("__row", "doc_id").join(alike.withColumnRenamed("node", "__row"), "__row")


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bits: int = 512, blocks: int = 96, width: int = 16, slack: float = 3.0, keep: list[str] | None = None) -> DataFrame:
    """docs, with its own columns, with one row of each group of near copies.

    Rows are near copies if their sets of ``shingle``-word shingles have a Jaccard similarity of
    ``similarity`` or more, or if a chain of such pairs joins them. Candidates are found by wide
    fingerprints of those sets: pairs that agree on one of ``blocks`` drawn choices of ``width`` bits
    and differ as much as texts of ``similarity`` do, up to ``slack`` standard deviations more. All
    pairs inside a component of candidates are then compared by their shingles, so nothing below
    ``similarity`` links; what the candidate search misses (see the README) stays.
    The smallest doc_id of a group stays (null last; ties to the smaller row). Rows without a word,
    null texts among them, are no copies of each other: all of them stay. Of repeated rows one stays.
    Columns of any name are kept; an empty table gives no rows; very long texts count as a whole.
    """
    cols = docs.columns
    stored = materialise(docs.select(F.struct(*(F.col(f"`{c}`") for c in cols)).alias("__doc")).withColumn("__row", F.monotonically_increasing_id()), "numbered", keep)
    own = stored.select("__row", "__doc.doc_id", "__doc.text")
    worded = own.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    groups = materialise(near_copy_groups(worded, shingle, similarity, bits, blocks, width, slack, keep), "groups", keep)
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__row")).alias("first")).select(F.col("first.__row").alias("__row"), F.lit(True).alias("__first"))
    gone = groups.join(first, "__row", "left_anti").select("__row")
    return stored.join(gone, "__row", "left_anti").select(*(F.col("__doc")[c].alias(c) for c in cols))
