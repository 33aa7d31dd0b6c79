import hashlib
import heapq
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docmill.llm import conversations, registry
from docmill.plans.shared import table

GOOD = re.compile("(s?(ua)+)?")
BLANKS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, final rows) over all edit sequences, by best-first search. rows: (role, text, must go, truncated)."""
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, final = heapq.heappop(heap)
        initials = "".join(r[:1] or "?" for r, _ in final)
        if i == len(rows) and GOOD.fullmatch(initials):
            return cost, audit, final
        if (i, audit) in done or not any(GOOD.fullmatch(initials + more) for more in ("", "a", "ua")):
            continue
        done.add((i, audit))
        for role in ("user", "assistant"):
            if len(audit) < 3 * len(rows) + 3:
                heapq.heappush(heap, (cost + 2, audit + "I", i, (*final, (role, ""))))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, final))
            if not gone:
                heapq.heappush(heap, (cost + cut, audit + "K", i + 1, (*final, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, (*final, (new, text))))


def brute(rows):
    """The contract, conversation by conversation: rows of (conv_id, turn, role, text)."""
    out = []
    for conv in dict.fromkeys(r[0] for r in rows):
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        turns = [t for t, _, _ in own if t is not None]
        faults, seen, marked = [], set(), []
        for _, role, text in own:
            bare = text.strip(BLANKS)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, final = cheapest(marked)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in final).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=str)


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table(spark, sf, "conversations").collect()]
    assert got(registry.QUERIES["op13_conversation_repair"](spark, sf)) == brute(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("suaoSUAOx", max_size=5), min_size=1, max_size=12))
def test_trie_gives_the_cheapest_edits(signatures):
    trie = conversations.Trie()
    for s in sorted(signatures):
        roles = {"s": "system", "u": "user", "a": "assistant", "o": "other", "x": "user"}
        want = cheapest([(roles[c.lower()], "t", c == "x", c.isupper()) for c in reversed(s)])
        assert trie.answer(s) == want[:2]
    assert trie.computed == 1 + len({s[:i] for s in signatures for i in range(1, len(s) + 1)})  # once per shared prefix


def odd_rows(seed):
    random.seed(seed)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "u"], ["Yes.", "No", None, "", " \x0b", "Well? ", "\x85", "a\nb!\x0c", "Yes."]
    return [(random.choice([*range(9), None]), random.choice([*range(6), None]), random.choice(roles), random.choice(texts)) for _ in range(70)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_odd_rows(spark, seed):
    rows = odd_rows(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, present string").repartition(3)
    assert got(conversations.repair(conversations.damaged(df))) == brute(rows)


def test_conversations_without_rows_and_empty_table(spark):
    kind = "conv_id long, turn long, role string, text string"
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "Hi.")], kind)
    assert got(conversations.repair(conversations.damaged(df))) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert got(conversations.repair(conversations.damaged(df.limit(0)))) == []


def test_one_long_conversation_and_repaired_rows(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"text {t}.") for t in range(3000)] + [(2, 0, "user", "Hi.")]
    df = conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = conversations.verdicts(df)
    lines = conversations.repaired(df, found).orderBy("conv_id", "position").collect()
    for r in conversations.repair(df).collect():
        own = [f"{x['role']}:{x['text']}" for x in lines if x["conv_id"] == r["conv_id"]]
        assert GOOD.fullmatch("".join(x[0] for x in own)) and hashlib.sha256("\n".join(own).encode()).hexdigest() == r["repaired_sha256"]
