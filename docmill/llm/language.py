"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from docmill.plans.shared import join_checked, materialise

#: Most frequent n-grams of a profile and of a text.
TOP = 400
#: Texts per language that a profile is fitted on, at most: those of the smallest hash.
FIT_TEXTS = 4000
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> itself if a letter or mark, else 0."""
    table = np.zeros(0x110000, np.uint32)
    at = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LM"]
    table[at] = at
    return table


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's 1-, 2- and 3-grams of letters and word ends as integers (21 bits each, word end 0), and their counts."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    keep = np.r_[False, (letter[1:] > 0) | (letter[:-1] > 0)] if len(letter) else np.zeros(0, bool)
    if not any(map(str.isalpha, text or "")):  # marks alone are no letters
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keep[0] = letter[0] > 0
    s = np.concatenate([[0], letter[keep], [0]]).astype(np.uint64)  # one 0 between words
    two = (s[:-1] << np.uint64(21)) | s[1:]
    three = (two[:-1] << np.uint64(21)) | s[2:]
    # a 2-gram has the top bit set and a letter; a 3-gram has a letter in the middle
    all_of = [s[s > 0], two[two > 0] | (np.uint64(1) << np.uint64(63)), three[s[1:-1] > 0]]
    return np.unique(np.concatenate(all_of), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams first; ties by their integers."""
    return keys[np.lexsort((keys, -counts))[:top]]


def training_rows(docs: DataFrame, fit_texts: int = FIT_TEXTS) -> DataFrame:
    """(lang, text): per lang the fit_texts texts whose hash is smallest. The hash alone is sorted, the text follows by a filter."""
    own = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    limit = own.select("lang", "h").distinct().withColumn("nth", nth).filter(F.col("nth") <= fit_texts).groupBy("lang").agg(F.max("h").alias("most"))
    limit = materialise(limit, "fit-limits")
    return join_checked(own, limit, ["lang"], "inner").filter("h <= most").dropDuplicates(["lang", "h"]).select("lang", "text")


def fit(docs: DataFrame, top: int = TOP, fit_texts: int = FIT_TEXTS) -> dict[str, np.ndarray]:
    """Profile of each lang of docs (lang, text): its most frequent n-grams, the first first.

    Rows without lang or text are left out; ties go to the smaller integer, without sign, as in a
    text's ranking. What reaches the driver is top n-grams per language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        sums: dict[str, dict[int, int]] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                own = sums.setdefault(lang, {})
                for k, n in zip(*(x.tolist() for x in grams(text)), strict=True):
                    own[k] = own.get(k, 0) + n
        for lang, own in sums.items():
            yield pd.DataFrame({"lang": lang, "gram": np.array(list(own), np.uint64).view(np.int64), "n": list(own.values())})

    counted = training_rows(docs, fit_texts).mapInPandas(count, "lang string, gram long, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counted.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram") < 0, "gram"))).filter(F.col("nth") <= top)
    out: dict[str, list] = {}
    for r in best.orderBy("lang", "nth").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64).view(np.uint64) for k, v in out.items()}


class Profiles:
    """Out-of-place distances of a text's ranking to each profile."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int):
        self.langs, self.top = sorted(profiles), top
        keys = np.unique(np.concatenate([profiles[k] for k in self.langs])) if self.langs else np.zeros(0, np.uint64)
        self.keys, self.place = keys, np.full((len(keys), len(self.langs)), -1)
        for j, lang in enumerate(self.langs):
            self.place[np.searchsorted(keys, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        mine = ranked(*grams(text), self.top)
        if not len(mine) or not self.langs:
            return UNDETERMINED, 0.0
        i = np.minimum(np.searchsorted(self.keys, mine), len(self.keys) - 1)
        place = np.where((self.keys[i] == mine)[:, None], self.place[i], -1)
        apart = np.where(place >= 0, np.abs(place - np.arange(len(mine))[:, None]), self.top).mean(0) / self.top
        best = int(apart.argmin())
        return self.langs[best], float(1 - apart[best])


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], top: int = TOP, extra: list[str] | None = None) -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score, and the columns of extra.

    lang_pred: the profile at the least mean out-of-place distance, ties to the first name; 'und'
    with score 0 for a null text, one without a letter, or when no profile was learned. score: 1
    minus that distance as a share of the largest one. Only text is looked at. Repeated rows get
    equal results; an empty table gives no rows. A text is ranked as a whole, however long: its
    n-grams are held as integers, about 40 bytes a character.
    """
    model = Profiles(profiles, top)
    own = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"__extra_{c}") for c in extra or []))
    names = [c for c in own.columns if c != "text"]
    schema = StructType([*(own.schema[c] for c in names), StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t.as_py()) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*names, "lang_pred", "score"])

    out = own.mapInArrow(run, schema)
    return out.select("doc_id", "lang_pred", "score", *(F.col(f"__extra_{c}").alias(c) for c in extra or []))


def held_out(doc_id: Column) -> Column:
    """Whether CRC-32 of doc_id as text leaves 2 when divided by 4; false without doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
