"""Text rules that run in Python: what is a string at once, and how many Python steps a plan has."""

import html
import random
import unicodedata

import pyarrow as pa

from docmill.functions import text
from docmill.queries import records


def test_python_holds_a_slice_of_the_texts():
    random.seed(1)
    texts = [None, "", *("".join(random.choice("aé한가ﬁ①&;amp <") for _ in range(random.randrange(60))) for _ in range(3000)), "é" * 3_000_000, None]
    assert text._nfkc(pa.array(texts)).to_pylist() == [t if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    assert text._unescape(pa.array(texts)).to_pylist() == [t if t is None else html.unescape(t) for t in texts]
    assert text._nfkc(pa.array([], pa.string())).to_pylist() == [] and text._nfkc(pa.array([None], pa.string())).to_pylist() == [None]
    most = 0

    def plain(own):
        nonlocal most
        most = max(most, own.nbytes if len(own) > 1 else 0)
        return pa.array([True] * len(own))

    assert text._by_slice(pa.array(["x" * 5000] * 2000), lambda t: t, plain).to_pylist() == ["x" * 5000] * 2000
    assert 0 < most < 1.1 * text.SLICE


def test_notices_are_cleaned_in_one_python_step(spark, sf):
    plan = records.notice_docs(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
