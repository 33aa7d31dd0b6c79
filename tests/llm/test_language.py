import zlib
from collections import Counter

from docmill.llm import language, registry


def brute_grams(text):
    words, word = [], ""
    for c in text.lower() + " ":
        if language._letters()[ord(c)]:
            word += c
        elif word:
            words.append(word)
            word = ""
    out = {}
    s = "\0" + "\0".join(words) + "\0"
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            g = s[i : i + n]
            if (n == 1 and g != "\0") or n == 2 or (n == 3 and g[1] != "\0"):
                out[g] = out.get(g, 0) + 1
    return out


def key(g):
    k = 0
    for c in g:
        k = k << 21 | ord(c)
    return k | (1 << 63 if len(g) == 2 else 0)


def test_grams_equal_brute_force():
    for text in ("a", "Ab, cd! é", "  x\n\ny1z ", "Çá va — 世界 ok"):
        k, n = language.grams(text)
        assert dict(zip(k.tolist(), n.tolist(), strict=True)) == {key(g): c for g, c in brute_grams(text).items()}
    assert all(len(x) == 0 for t in (None, "", "12 ?!", "\u0301 1\u0308") for x in language.grams(t))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = registry.op5_language(spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_edges(spark):
    rows = [(1, "the cat and the dog and the bird", "en", 0), (2, "der hund und die katze und der vogel", "de", 0), (3, None, "en", 0), (4, "", None, 0), (None, "12 34", None, 0), (5, "the " * 40000, None, 0), (5, "the " * 40000, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    profiles = language.fit(df)
    got = [(r.doc_id, r.lang_pred) for r in language.predict(df, profiles).collect()]
    assert got == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (None, "und"), (5, "en"), (5, "en")]
    assert {r.lang_pred for r in language.predict(df, {}).collect()} == {"und"}
    assert language.fit(df.filter("doc_id > 9")) == {}
    assert language.predict(df.filter("doc_id > 9"), profiles).count() == 0


def test_prediction_equals_brute_force(spark, sf):
    """Profiles, ranks and out-of-place distances in plain Python on all documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    top = 400
    best = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], key(x[0])))[:top]]
    sums = {}
    for text, lang in {(r.text, r.lang) for r in docs if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and r.text is not None}:
        if any(map(str.isalpha, text)):
            sums.setdefault(lang, Counter()).update(brute_grams(text))
    places = {lang: {g: i for i, g in enumerate(best(c))} for lang, c in sums.items()}
    got = {r.doc_id: r for r in registry.op5_language(spark, sf).collect()}
    for r in docs:
        mine = best(brute_grams(r.text)) if r.text and any(map(str.isalpha, r.text)) else []
        if not mine:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        apart = {lang: sum(abs(own[g] - i) if g in own else top for i, g in enumerate(mine)) / len(mine) / top for lang, own in places.items()}
        lang = min(sorted(apart), key=lambda x: round(apart[x], 12))
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - (1 - apart[lang])) < 1e-9
