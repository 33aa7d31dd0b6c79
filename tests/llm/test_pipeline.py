"""The pipeline's stages against brute force on the small documents table and on edge cases."""

import numpy as np
import public_tokenizers

import corpus_pipeline
from docmill.llm import simhash
from tests.llm.test_native import ROWS, norm
from tests.llm.test_packing import check


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages_on_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.collect())
    start, good, exact, near, mixed, packed = kept
    words = {r.doc_id: len((r.text or "").split()) for r in start}
    assert {r.doc_id for r in good} <= {d for d, n in words.items() if n >= 50}
    first = {}
    for r in good:
        key = (-len(r.text), r.doc_id)
        first[norm(r.text)] = min(first.get(norm(r.text), key), key)
    assert {r.doc_id for r in exact} == {d for _, d in first.values()}
    left, sets = {r.doc_id for r in near}, {r.doc_id: shingles(r.text) for r in exact}
    ids = sorted(sets)
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for i, a in enumerate(ids) for b in ids[i + 1 :]}
    assert not [p for p, s in like.items() if s >= 0.8 and set(p) <= left]
    assert all(any(s >= 0.8 and d in p for p, s in like.items()) for d in set(ids) - left)
    assert {r.doc_id for r in mixed} <= left and max(sum(m.doc_id == r.doc_id for m in mixed) for r in mixed) <= 2
    assert sum(p.length for p in packed) == sum(p.doc_tokens for p in packed if p.start == 0)
    assert sum(p.start == 0 for p in packed) == len(mixed)


def test_edge_rows_pass_every_stage(spark, tmp_path):
    words = lambda seed: " ".join(str(x) for x in np.random.default_rng(seed).integers(0, 10**6, 80))
    rows = [(r[0], r[1], None, r[2], None) for r in ROWS] + [(50 + i, words(i), "en", "s", 1) for i in range(6)] + [(50, words(0), "en", "s", 1), (None, words(1), None, None, None)]
    for part in (rows, []):
        docs = spark.createDataFrame(part, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, "").write.parquet(str(tmp_path / f"{len(part)}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{len(part)}-{name}"))
        assert (docs.count() > 0) == bool(part)


def test_run_packs_its_input(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and len({(r.sequence_id, r.offset) for r in out}) == len(out)
    assert public_tokenizers and check


def test_columns_with_odd_names_stay(spark):
    words = lambda seed: " ".join(str(x) for x in np.random.default_rng(seed).integers(0, 10**6, 80))
    names = ["doc_id", "text", "lang", "source", "n_chars", "a.b", "kept", "size", "often", "__n", "first"]
    docs = spark.createDataFrame([(i, words(i), None, "s", 1, "v", None, 7, "o", 2, "f") for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, kept string, size long, often string, `__n` int, first string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == names
        rows = docs.collect()
        assert rows and all((r["a.b"], r["size"], r["often"], r["__n"], r["first"]) == ("v", 7, "o", 2, "f") for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)


def test_near_copies_equal_brute_force(spark):
    """One row of each component of pairs at 0.8 or more stays; of the components at most a tenth may be missed."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect() if (r.text or "").split()}
    first, of = {}, {}
    for d in sorted(texts):
        of[d] = first.setdefault(frozenset(shingles(texts[d])), d)
    sets, on = {d: s for s, d in first.items()}, {}
    for d, own in sets.items():
        for x in own:
            on.setdefault(x, []).append(d)
    shared = {}
    for same in on.values():
        for i, a in enumerate(same):
            for b in same[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    at, joined = {d: d for d in sets}, 0
    for (a, b), n in sorted(shared.items()):
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) and at[a] != at[b]:
            low, high = sorted((at[a], at[b]))
            at, joined = {d: low if x == high else x for d, x in at.items()}, joined + 1
    want = {d for d in texts if at[of[d]] == d}
    left = {r.doc_id for r in simhash.drop_near_copies(docs).collect()} & set(texts)
    assert want <= left and len(left - want) <= 0.1 * joined and joined >= 4
