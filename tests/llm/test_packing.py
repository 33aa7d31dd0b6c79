import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docmill.llm import packing, registry

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(pieces, texts, window=2048):
    """Every id of every text lies in one piece; sequences are gapless; padding is little."""
    tok = Tokenizer.from_file(PATH)
    by = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
    total = 0
    for d, text in texts.items():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        at = 0
        for p in sorted(by[d], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    seqs = {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append(p)
    assert sorted(seqs) == list(range(len(seqs)))
    pad = 0
    for own in seqs.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        pad += 0 if at & (at - 1) == 0 else window - at
    return pad, total


def test_query_packs_every_token(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pad, total = check(registry.op4_packing(spark, sf).collect(), texts)
    assert pad <= 0.03 * total


def test_edges(spark):
    texts = {1: None, 2: "", 3: "a", 4: "word " * 5000, 5: "<|endoftext|> and more"}
    df = spark.createDataFrame([(d, t, 0) for d, t in texts.items()], "doc_id long, text string, length int")
    out = packing.pack(df, PATH, with_ids=True)
    check(out.collect(), texts)
    ids = packing.sequences(out).collect()
    assert all(len(r.ids) == 2048 or len(r.ids) & (len(r.ids) - 1) == 0 for r in ids)
    assert packing.pack(df.filter("doc_id > 9"), PATH).count() == 0
    twice = packing.pack(df.unionByName(df), PATH)
    assert twice.count() == 2 * out.count()
    assert twice.select("sequence_id", "offset").distinct().count() == twice.count()


def test_many_tasks_join_without_broadcast(spark, monkeypatch):
    texts = {d: "word " * (d % 7) for d in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    check(packing.pack(df, PATH).collect(), texts)


def test_null_and_text_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), ("x", None)], "doc_id string, text string")
    assert packing.pack(df, PATH).count() == 3


@pytest.mark.parametrize("seed", [0, 1])
def test_plan_uses_the_histogram_exactly(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.geometric(0.01, 20000), 256)
    have = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    used, waste = {}, 0
    for own, times in packing.plan(have, 256):
        assert sum(own) <= 256 and times > 0
        waste += times * (256 - sum(own))
        for v in own:
            used[v] = used.get(v, 0) + times
    assert used == have
    assert waste <= 0.02 * lengths.sum()


def test_long_runs_give_the_ids_of_tokenizers():
    tok, own, n = Tokenizer.from_file(PATH), packing.Encoder(open(PATH, "rb").read()), 1_200_000
    rng = np.random.default_rng(0)
    mixed = "".join(rng.choice(list(" \n\t　\xa0"), 100_000))
    for text in (" " * n, "\n" * n + "x", " " * n + "x y", "a" * n, f"word {mixed}\nend  <|endoftext|>{' ' * 5000}<|endoftext|>" + "\n" * 5000, ("ab" + " " * 4096 + "'s " + "\x1c" * 5000 + " " * 4097 + "\n.") * 9):
        assert own.ids(text) == tok.encode(text, add_special_tokens=False).ids
