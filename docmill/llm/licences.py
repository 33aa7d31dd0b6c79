"""Licence scans by matching statistics on a generalised suffix automaton of template words."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.licence_texts import PHRASES, TEMPLATES, short_templates

#: Bytes of words (digits, a-z, all beyond ASCII) to themselves, A-Z to a-z, all others to a space.
_TO_WORDS = bytes(b if b >= 128 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Shortest match, in words, that a chain is made of; words of the text that a chain may skip.
MIN_MATCH, MAX_GAP = 4, 25
#: Share of a template's words that a span must cover; templates under SHORT words must stand without a gap and take the second, those under WHOLE in full.
COVER, COVER_SHORT, SHORT, WHOLE = 0.6, 0.9, 20, 12


EVERY = TEMPLATES | short_templates()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


class Automaton:
    """Suffix automaton of several word sequences; states know where in which sequence their words end."""

    def __init__(self, sequences: list[list[bytes]]):
        self.vocab = {w: i for i, w in enumerate(sorted({w for s in sequences for w in s}))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ids = [[self.vocab[w] for w in s] for s in sequences]
        for s in ids:
            last = 0
            for c in s:
                last = self._extend(last, c)
        self.ends: list[set[tuple[int, int]]] = [set() for _ in self.next]
        for k, s in enumerate(ids):
            at = 0
            for i, c in enumerate(s):
                at = self.next[at][c]
                self.ends[at].add((k, i + 1))
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            self.ends[self.link[v]] |= self.ends[v]
        self.ends[0] = set()

    def _extend(self, last: int, c: int) -> int:
        there = self.next[last].get(c)
        if there is not None and self.length[there] == self.length[last] + 1:
            return there
        if there is not None:
            return self._clone(last, c, there)
        new = self._state({}, self.length[last] + 1, 0)
        while last >= 0 and c not in self.next[last]:
            self.next[last][c] = new
            last = self.link[last]
        if last >= 0:
            there = self.next[last][c]
            self.link[new] = there if self.length[there] == self.length[last] + 1 else self._clone(last, c, there)
        return new

    def _state(self, following: dict[int, int], length: int, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, last: int, c: int, there: int) -> int:
        new = self._state(dict(self.next[there]), self.length[last] + 1, self.link[there])
        self.link[there] = new
        while last >= 0 and self.next[last].get(c) == there:
            self.next[last][c] = new
            last = self.link[last]
        return new

    def find(self, words: list[bytes]) -> int:
        at = 0
        for w in words:
            at = self.next[at][self.vocab[w]]
        return at


class Scanner:
    """Streams a text's words through the automaton; gives phrase places and covered template spans."""

    def __init__(self, templates: dict[str, str] = EVERY, phrases: dict[str, str] = PHRASES):
        self.names, self.labels = list(templates), [k.split("#")[0] for k in templates]
        self.templates = [words_of(t) for t in templates.values()]
        own = [words_of(p) for p in phrases]
        self.sam = sam = Automaton(self.templates + own)
        ends: list[list[tuple[str, int]]] = [[] for _ in sam.next]
        for p, label in zip(own, phrases.values(), strict=True):
            ends[sam.find(p)].append((label, len(p)))
        # a phrase ends where the state is its own or one below it in the suffix links
        self.phrases = [None] * len(sam.next)
        for v in sorted(range(1, len(sam.next)), key=sam.length.__getitem__):
            self.phrases[v] = ends[v] + (self.phrases[sam.link[v]] or []) or None
        self.least = min(map(len, own), default=MIN_MATCH)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, float]]]:
        """(phrase label, start) of every place, and (label, first word, last word, coverage) of spans."""
        sam, vocab = self.sam, self.sam.vocab
        known = [i for i, w in enumerate(words) if w in vocab]
        places, anchors = [], {}
        n, i = len(known), 0
        while i < n:
            j = i + 1
            while j < n and known[j] == known[j - 1] + 1:
                j += 1
            if j - i >= self.least:
                self._run([vocab[words[k]] for k in known[i:j]], known[i], places, anchors)
            i = j
        return places, self._spans(anchors)

    def _run(self, ids: list[int], first: int, places: list, anchors: dict) -> None:
        """Matching statistics of a run of known words; matches that can't be made longer become anchors."""
        following, link, lengths, ends = self.sam.next, self.sam.link, self.sam.length, self.phrases
        at = length = 0
        for k, c in enumerate([*ids, -1]):
            was, had = at, length
            while at and c not in following[at]:
                at = link[at]
                length = lengths[at]
            if c in following[at]:
                at = following[at][c]
                length += 1
            if length <= had and had >= MIN_MATCH:
                for t, end in self.sam.ends[was]:
                    if t < len(self.templates):
                        anchors.setdefault(t, []).append((first + k - had, end - had, had))
            if ends[at]:
                places.extend((label, first + k - size + 1) for label, size in ends[at] if size <= length)

    def _spans(self, anchors: dict[int, list[tuple[int, int, int]]]) -> list[tuple[str, int, int, float]]:
        """Chains of anchors in the order of text and template; of overlapping spans the one that covers most stays."""
        found = []
        for t, own in anchors.items():
            own.sort()
            best: list[tuple[int, int]] = []  # covered words, anchor before
            words = len(self.templates[t])
            gap = MAX_GAP if words >= SHORT else 0
            for i, (at, pos, size) in enumerate(own):
                top = (size, -1)
                for j in range(i - 1, -1, -1):
                    a, p, s = own[j]
                    if a + words + gap < at:
                        break
                    shared = max(0, a + s - at, p + s - pos)
                    if p < pos and a < at and at - (a + s) <= gap and shared < size:
                        top = max(top, (best[j][0] + size - shared, j))
                best.append(top)
            need = COVER if words >= SHORT else COVER_SHORT if words >= WHOLE else 1.0
            for i in range(len(own)):
                if best[i][0] >= need * words:
                    start = i
                    while best[start][1] >= 0:
                        start = best[start][1]
                    found.append((best[i][0], own[start][0], own[i][0] + own[i][2] - 1, t))
        # words that a span skips tell of another text: they count like words that it lacks
        share = lambda f: min(1.0, f[0] / (len(self.templates[f[3]]) + max(0, f[2] - f[1] + 1 - f[0])))
        found.sort(key=lambda f: (-share(f) - (f[0] > SHORT), -f[0], f[1], f[3]))
        out, taken = [], []  # taken: spans apart from each other, in order
        for covered, a, b, t in found:
            i = bisect_left(taken, (a,))
            if (i == len(taken) or b < taken[i][0]) and (i == 0 or taken[i - 1][1] < a):
                insort(taken, (a, b))
                out.append((self.labels[t], a, b, share((covered, a, b, t))))
        return sorted(out, key=lambda s: (s[1], s[0]))


SPANS = "array<struct<label: string, first_word: long, last_word: long, coverage: double>>"


def scan(docs: DataFrame, templates: dict[str, str] = EVERY, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are lower-cased runs without ASCII other than letters and digits; a null text has none.
    n_base: places of all phrases, overlapping ones too; first_word and last_word: their smallest
    and largest start, null without one. spans: template spans, none of which overlap, with the
    share of the template they cover. labels: those of phrases and spans. score: the largest
    coverage, less for words that a span skips, 1 where a phrase stands, 0 without either. Of
    overlapping spans the one that covers most stays, ties to the first. Repeated rows get equal results; an empty table gives no rows;
    other columns of docs are not read. Time and memory follow the length of a text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for b in batches:
            rows = []
            for text in b["text"]:
                words = words_of(text.as_py())
                places, spans = scanner.scan(words)
                base, starts = sorted({x for x, _ in places}), [i for _, i in places]
                both = sorted({*base, *(s[0] for s in spans)})
                score = max([1.0] * bool(places) + [s[3] for s in spans], default=0.0)
                rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(both), score, [dict(zip(("label", "first_word", "last_word", "coverage"), s, strict=True)) for s in spans]))
            cols = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}")


def with_licence(docs: DataFrame, **options) -> DataFrame:
    """doc_id and one row per covered span, for review: label, first_word, last_word, coverage.

    Documents without a span, null texts among them, give no row; repeated rows give theirs each; an empty
    table gives no rows. Spans of a document don't overlap, so there are no ties.
    """
    return scan(docs, **options).select("doc_id", F.explode("spans").alias("span")).select("doc_id", "span.*")
