"""Repair of a conversation's roles by a dynamic programme shared along a trie of signatures.

A row counts for the repair by its role's initial and its fault only, so a conversation is a
signature of one letter a row. Signatures are read from the last row to the first: conversations
with one ending share a prefix in the trie. A layer of the programme holds the least cost from each
state of the role pattern to the end; it depends on the rows after it alone, so it is computed once
per prefix, and at a terminal node the cheapest edits are read off from the layers above. Distinct
signatures are sorted by range, each task walks its part of the trie with one stack of layers.

Texts are shuffled once: the rows of a conversation follow its edits through one task as a stream,
in sorted order, and none but the current row is held.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.plans.shared import materialise

#: States of the pattern (s?(ua)+)? by the initials so far: none, s, one u too many, whole pairs.
START, SYSTEM, USER, PAIRS = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): PAIRS, (PAIRS, "u"): USER}
#: What may be put in at a state; the roles that edits can give.
NEXT = {START: "u", SYSTEM: "u", USER: "a", PAIRS: "u"}
ROLES = {"u": "user", "a": "assistant"}
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
_BLANK = r"[^\x20\x09-\x0D]"
_SPACES = " \t\n\x0b\x0c\r"
_NEVER = 1 << 60


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text), damaged by the CRC of conversation and turn; present is false for dropped rows.

    Nulls of role and text, and in the text that is hashed, become one space. Of 20 remainders 0 drops
    a row, 1 empties its text, 2 removes its stops, 3 repeats it, 4 makes it the user's.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    own = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    own = own.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return own.select("conv_id", "turn", "role", "text", (F.col("kind") != 0).alias("present"), copies.alias("copy")).drop("copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with text_key, which stands for the text; both are null in rows that aren't there."""
    there = lambda c: F.when(F.col("present"), c)
    return rows.select("conv_id", "turn", there(F.col("role")).alias("role"), there(F.col("text")).alias("text"), "present", there(F.unhex(F.md5("text"))).alias("text_key"))


def _order(*before: str | Column) -> list:
    return ["conv_id", *before, F.asc_nulls_first("turn"), "role", "text_key"]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _tables(rows: Iterable[tuple], names: list[str], kinds: list[pa.DataType], n: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == n:
            yield _batch(held, names, kinds)
            held = []
    yield _batch(held, names, kinds)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _read(rows: Iterable[tuple]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, signature) of a conversation's rows in order.

    A signature's letters stand for rows from last to first: x must go, else the role's initial (o:
    another), a capital if truncated.
    """
    first = last = before = None
    turns = blank = duplicate = truncated = illegal = 0
    letters = bytearray()
    for _, turn, role, present, is_blank, is_cut, again in rows:
        if not present:
            continue
        if turn is not None and turn != last:
            first, last, turns = turn if first is None else first, turn, turns + 1
        if before is not None:
            illegal += before + role not in ("su", "ua", "au")
        before = role
        blank += is_blank
        duplicate += again and not is_blank
        truncated += is_cut and not again
        letter = "x" if is_blank or again else role if role in ("s", "u", "a") else "o"
        letters += (letter.upper() if is_cut and letter != "x" else letter).encode()
    gaps = 0 if first is None else last - first + 1 - turns
    return gaps, blank, duplicate, truncated, illegal, letters[::-1].decode()


class Trie:
    """The layers along one path of the trie of signatures; sorted signatures reuse what they share with the one before."""

    def __init__(self) -> None:
        self.path, self.costs, self.choices = "", array("q"), bytearray()
        #: Layers that have been computed.
        self.computed = 0
        self._layer({})

    def _layer(self, ways: dict[int, list[tuple[int, str]]]) -> None:
        """Append the layer whose states have these ways on without an insertion, (cost, letter) each."""
        self.computed += 1
        own = [min((c for c, _ in ways[q]), default=_NEVER) for q in range(4)] if ways else [0, _NEVER, _NEVER, 0]
        cost = own.copy()
        cost[USER] = min(own[USER], own[PAIRS] + INSERT)
        cost[PAIRS] = min(own[PAIRS], own[USER] + INSERT)
        for q in (START, SYSTEM):
            cost[q] = min(own[q], cost[USER] + INSERT)
        for q in range(4):
            letters = [k for c, k in ways.get(q, []) if c == cost[q]]
            if cost[STEP[q, NEXT[q]]] + INSERT == cost[q]:
                letters.append("I")
            self.choices += (min(letters) if letters else ".").encode()
        self.costs.extend(cost)

    def _add(self, letter: str) -> None:
        """The layer of a row before the rows of the path."""
        after, fault, role = self.costs[-4:], TRUNCATED * letter.isupper(), letter.lower()
        ways: dict[int, list[tuple[int, str]]] = {}
        for q in range(4):
            ways[q] = [(after[q] + DELETE, "D")]
            if role != "x":
                ways[q].append((after[STEP[q, NEXT[q]]] + REROLE + fault, "R"))
                if (q, role) in STEP:
                    ways[q].append((after[STEP[q, role]] + fault, "K"))
        self._layer(ways)

    def answer(self, signature: str) -> tuple[int, str]:
        """(cost, audit): the cheapest edits' letters in order, the ASCII-least of equals."""
        shared = next((i for i, (a, b) in enumerate(zip(self.path, signature, strict=False)) if a != b), min(len(self.path), len(signature)))
        del self.costs[4 * shared + 4 :], self.choices[4 * shared + 4 :]
        for letter in signature[shared:]:
            self._add(letter)
        self.path = signature
        depth, q, audit = len(signature), START, bytearray()
        while (choice := chr(self.choices[4 * depth + q])) != ".":
            audit += choice.encode()
            if choice in "IR":
                q = STEP[q, NEXT[q]]
            elif choice == "K":
                q = STEP[q, signature[depth - 1].lower()]
            depth -= choice != "I"
        return self.costs[-4], audit.decode()


def verdicts(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation in rows, written.

    rows: conv_id, turn, role, text, present (false: the row isn't there, its conversation is). Rows are
    taken by turn (nulls first), then role, then MD5 of the text, so equal rows stand together. A row's
    first fault counts: blank, duplicate (role and text stood before), truncated (no stop at its end).
    """
    keyed = _keyed(rows)
    end = F.substring(F.expr(r"trim(TRAILING ' \t\n\u000b\u000c\r' FROM text)"), -1, 1)
    blank = ~F.col("text").rlike(_BLANK)
    marks = [F.coalesce(c, F.lit(False)).alias(n) for c, n in ((blank, "is_blank"), (~blank & ~end.isin(".", "!", "?"), "is_cut"))]
    keys = keyed.select("conv_id", "turn", "role", "present", "text_key", *marks).repartition("conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "text_key").orderBy(F.asc_nulls_first("turn")))  # needs no further shuffle
    keys = keys.withColumn("again", F.col("present") & (nth > 1)).sortWithinPartitions(*_order(), "again")
    keys = keys.select("conv_id", F.col("turn").cast("long").alias("turn"), F.substring("role", 1, 1).alias("role"), "present", "is_blank", "is_cut", "again")
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            kinds = [first.schema.field("conv_id").type, *[pa.int64()] * 5, pa.string()]
            stream = _stream(b for part in ([first], batches) for b in part)
            yield from _tables(((conv, *_read(group)) for conv, group in groupby(stream, itemgetter(0))), names, kinds)

    found = materialise(keys.mapInArrow(read, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"), "signatures", keep)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        yield from _tables(((s, *trie.answer(s)) for (s,) in _stream(batches)), ["signature", "cost", "audit"], [pa.string(), pa.int64(), pa.string()])

    distinct = found.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    answers = materialise(distinct.mapInArrow(solve, "signature string, cost long, audit string"), "answers", keep)
    return materialise(found.join(answers, "signature").select("conv_id", *names[1:-1], "cost", "audit"), "verdicts", keep)


def _edited(rows: Iterator[tuple], audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation; rows: its (role, text) in order."""
    q = START
    for choice in audit:
        role, text = ("", "") if choice == "I" else next(rows)
        if choice == "D":
            continue
        letter = role[:1] if choice == "K" else NEXT[q]
        yield (role if choice == "K" else ROLES[letter]), text
        q = STEP[q, letter]


def _together(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's verdict, then its rows in order, in one partition."""
    heads = found.select("conv_id", F.lit(True).alias("head"), *found.columns[1:])
    lines = _keyed(rows).filter("present").select("conv_id", F.lit(False).alias("head"), "turn", "role", "text", "text_key")
    both = heads.unionByName(lines, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(*_order(F.desc("head"))).drop("turn", "text_key")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[str, str]]]]:
    """(verdict, repaired rows) of each conversation of ``_together``; the rows must be used up."""
    for _, group in groupby(_stream(batches), itemgetter(0)):
        head = next(group)
        lines = (r[-2:] for r in group)
        yield (head[0], *head[2:-2]), _edited(lines, head[-3])
        for _ in lines:
            pass


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the repaired conversations, of rows and their ``verdicts``. Conversations that end up empty have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            kinds = [first.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string()]
            whole = _conversations(b for part in ([first], batches) for b in part)
            yield from _tables(((head[0], i, *line) for head, lines in whole for i, line in enumerate(lines)), ["conv_id", "position", "role", "text"], kinds, 1000)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return _together(rows, found).mapInArrow(run, f"conv_id {kind}, position long, role string, text string")


def _digest(lines: Iterable[tuple[str, str]]) -> str:
    whole = hashlib.sha256()
    for i, (role, text) in enumerate(lines):
        whole.update(f"{chr(10) * (i > 0)}{role}:{text}".encode())
    return whole.hexdigest()


def repair(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``verdicts`` of rows with repaired_sha256: of the repaired role:text, newline-joined.

    Edits are K(eep), R(erole to user or assistant) at 2, D(elete) at 3, a must for blank rows and
    duplicates, and I(nsert an empty row) at 2; truncated rows that stay add 1. Role initials must then
    match ``(s?(ua)+)?``. Ties: the ASCII-least audit.

    Null turns come first and count for no gap. A null conv_id is a conversation of its own. One without
    rows has zeros, an empty audit and the hash of nothing; an empty table gives no rows. Role and text
    must not be null where a row is present (``damaged`` sees to that). Other columns are not read. A
    conversation's rows pass one task, in constant memory but for some 40 bytes a row.
    """
    found = verdicts(rows, keep)
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = [*found.columns, "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            kinds = [first.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
            whole = _conversations(b for part in ([first], batches) for b in part)
            yield from _tables(((*head, _digest(lines)) for head, lines in whole), names, kinds)

    return _together(rows, found).mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in names[1:-2]) + ", audit string, repaired_sha256 string")
