"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Regexes propose spans. Five labelers (shape, checksum, gazetteer, context, surroundings) vote yes,
no or abstain on each. The votes are counted in Spark; expectation-maximisation on the counts of
vote patterns (3^5 per kind at most) estimates how often each labeler is right. The patterns'
probabilities are soft labels for a logistic span classifier, fitted on a bounded sample of
candidates. Spans of the base rules stay whatever the classifier says; it decides on the others.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.plans.shared import materialise

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "name", "national_id", "secret", "iban", "birth_date", "address"]
LABELERS = ["shape", "checksum", "gazetteer", "context", "surroundings"]
#: Candidates that the classifier is fitted on, at most: of each kind as many of the smallest hash, so a frequent kind doesn't displace a rare one.
FIT_CANDIDATES = 30_000
#: Hashed features of the classifier; characters of context on either side.
FEATURES, CONTEXT = 1 << 12, 40

# Gazetteers and cue words.
TOP_DOMAINS = set("com org net edu gov info io de fr es uk eu it nl ch at be us ca mx ar co jp cn kr in br ru pl se no fi dk".split())
CALLING_CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 358 380 420 421 852 886 971 972".split())
FIRST_NAMES = set("james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen anna maria hans peter klaus ursula sabine jean pierre marie jacques claire jose juan carmen luis ana pedro laura sofia emma paul mark lucas leon".split())
CUES = {
    "email": "email e-mail mail contact correo courriel kontakt write",
    "ip": "ip host server address client login from remote dirección adresse",
    "card": "card visa mastercard credit tarjeta karte carte amex payment",
    "phone": "phone tel call mobile telephone fax teléfono telefon téléphone handy móvil",
    "name": "name mr mrs ms dr prof herr frau señor señora sr sra monsieur madame mme signed by heiße appelle llamo",
    "national_id": "ssn social security id passport national dni ausweis",
    "secret": "token secret password passwd key api apikey credential bearer authorization private aws github",
    "iban": "iban account konto compte cuenta bank bic überweisung virement transfer",
    "birth_date": "born birth birthday birthdate dob geboren geburtsdatum né née naissance nacido nacida nacimiento",
    "address": "address lives live street adresse anschrift wohnt wohnhaft habite domicilio dirección vive calle rue",
}
CUES = {k: set(v.split()) for k, v in CUES.items()}
#: Kinds that are candidates only behind a cue word, which then tells nothing more.
CUED = {"name", "secret", "birth_date"}
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "ES": 24, "FR": 27, "GB": 22, "IT": 27, "NL": 18, "PL": 28, "PT": 25, "SE": 24}
NO_NAMES = set("the this that these those january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday university street company error default unknown none null true false".split())
AGAINST = set("version isbn issn order invoice page chapter section figure table release build serial item sku total".split())

CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOOSE_PHONE = re.compile(r"(?<![\w+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?!\w)")
NATIONAL = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
SECRET = re.compile(r"(?:token|secret|passw(?:or)?d|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_+/-]{12,})", re.I)
NAMED = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señora?|Sra?|Monsieur|Madame|Mme|[Nn]ame:|name is|I am|[Ii]ch heiße|m'appelle|me llamo)\.? ([A-Z][a-zß-ÿ]+(?: [A-Z][a-zß-ÿ]+)?)")
KNOWN_KEY = re.compile(r"(?<![A-Za-z0-9_-])(?:A[KS]IA[0-9A-Z]{16}|gh[oprsu]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,})")
BEARER = re.compile(r"[Bb]earer\s{1,3}([A-Za-z0-9._~+/-]{16,}={0,2})")
PRIVATE_KEY, KEY_END = re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"), re.compile(r"-----END [A-Z ]{0,20}PRIVATE KEY-----")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
BIRTH = re.compile(r"(?<!\w)(?:born|birth(?:day|date)?|dob|geboren|geburtsdatum|née?|naissance|nacid[oa]|nacimiento)\W{1,3}(?:[^\W\d]{1,5}\W{1,2}){0,2}([0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])", re.I)
ADDRESS = re.compile(
    r"(?<![\w.])[0-9]{1,5}[a-z]? (?:[A-Z][a-zà-ÿ'-]{1,20} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Square|Way)(?!\w)"
    r"|(?<![\w.])[0-9]{1,4},? (?:rue|avenue|boulevard|place|quai|chemin) (?:(?:de|du|des|la|le|les|l'|d') ?){0,2}[A-ZÀ-Ý][a-zà-ÿ-]{1,20}"
    r"|(?<!\w)(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo) (?:(?:de|del|la|las|los|el) ){0,2}[A-ZÀ-Ý][a-zà-ÿ-]{1,20},? [0-9]{1,5}(?!\w)"
    r"|(?<!\w)[A-ZÄÖÜ][a-zäöüß-]{1,20}(?:straße|strasse|str\.|weg|platz|gasse|allee) [0-9]{1,5}[a-z]?(?!\w)"
)
DATE_PARTS = re.compile("[0-9]+")
WORDS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from their @ in linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        end = domain.end() if domain else end
        if domain:
            out.append((start, end))
        at = text.find("@", max(end, at + 1))
    return out


def addresses(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Matches of four dotted numbers: those with parts up to 255, and the others."""
    good, bad = [], []
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            own = parts[i : i + 4]
            size = sum(map(len, own)) + 3
            fine = all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in own)
            (good if fine else bad).append((at, at + size))
            at += size + 1
    return good, bad


def spans_of(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans of the base rules, by kind and start, and further candidates."""
    base, more = [("email", *s) for s in emails(text)], []
    if re.search("[0-9]", text):
        good, bad = addresses(text)
        base += [("ip", *s) for s in good]
        more += [("ip", *s) for s in bad]
        for m in CARD.finditer(text):
            if len(m[0]) >= 13 and 13 <= len(digits := re.sub("[ -]", "", m[0])) <= 19:
                (base if len(digits) >= 16 and luhn(digits) else more).append(("card", *m.span()))
        if "+" in text:
            base += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
        more += [("phone", *m.span()) for m in LOOSE_PHONE.finditer(text)]
        more += [("national_id", *m.span()) for m in NATIONAL.finditer(text)]
        more += [("iban", *m.span()) for m in IBAN.finditer(text)]
        more += [("birth_date", *m.span(1)) for m in BIRTH.finditer(text)]
        more += [("address", *m.span()) for m in ADDRESS.finditer(text)]
    if "=" in text or ":" in text:
        more += [("secret", *m.span(1)) for m in SECRET.finditer(text)]
    more += [("secret", *m.span()) for m in KNOWN_KEY.finditer(text)]
    more += [("secret", *m.span(1)) for m in BEARER.finditer(text)]
    if "PRIVATE KEY-----" in text:
        at = 0
        while (m := PRIVATE_KEY.search(text, at)) and (end := KEY_END.search(text, m.end())):
            more.append(("secret", m.start(), end.end()))
            at = end.end()
    more += [("name", *m.span(1)) for m in NAMED.finditer(text)]
    order = {k: i for i, k in enumerate(KINDS)}
    base.sort(key=lambda s: (order[s[0]], s[1]))
    taken = covered(base)
    return base, [s for s in more if not touches(taken, s[1], s[2])]


def covered(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The places that spans cover, as intervals apart from each other, in order."""
    out: list[tuple[int, int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def touches(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a to b shares a character with one of taken, intervals in order that don't overlap."""
    i = bisect_left(taken, (b,))
    return i > 0 and taken[i - 1][1] > a


def shape_vote(kind: str, span: str, digits: str, base: bool) -> int:
    """Whether the span looks as its kind does: every kind can be denied by it."""
    if kind == "email":
        local, domain = span.rsplit("@", 1)
        return -1 if local[0] in ".%-" or local[-1] == "." or ".." in local or not domain.rsplit(".", 1)[-1].isalpha() else 1
    if kind == "ip":
        return -1 if not base or any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else 1
    if kind == "card":
        return 1 if digits[0] in "3456" and len(set(digits)) > 2 else -1
    if kind == "phone":
        return -1 if not 8 <= len(digits) <= 15 or re.search(r"([0-9])\1{5}", digits) else 1 if base else 0
    if kind == "national_id":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    if kind == "secret":
        if KNOWN_KEY.match(span) or PRIVATE_KEY.match(span):
            return 1
        return -1 if span.isdigit() or len(set(span)) <= 6 or span.isalpha() and (span.islower() or span.istitle()) else 0
    if kind == "iban":
        size = IBAN_LENGTHS.get(span[:2])
        return 0 if size is None else 1 if size == len(span.replace(" ", "")) else -1
    if kind == "birth_date":
        return 1 if any(1900 <= int(x) <= 2026 for x in DATE_PARTS.findall(span)) else -1
    if kind == "address":
        return -1 if any(len(n) > 4 for n in DATE_PARTS.findall(span)) else 1
    return -1 if any(w.lower() in NO_NAMES for w in span.split(" ")) else 1 if span.count(" ") == 1 else 0


def born(span: str) -> bool:
    """Whether a date is one on which someone alive was born; day and month stand in either order."""
    parts = [int(x) for x in DATE_PARTS.findall(span)]
    year, one, two = (parts[0], *parts[1:]) if span[:4].isdigit() else (parts[2], *parts[:2])
    return 1900 <= year <= 2026 and 1 <= min(one, two) <= 12 and 1 <= max(one, two) <= 31


def check_vote(kind: str, span: str, digits: str, base: bool) -> int:
    """What can be computed of the span: check sums, numbers of digits, kinds of characters."""
    if kind == "card":
        return 1 if luhn(digits) and len(digits) >= 16 else -1
    if kind == "ip":
        return 1 if base else -1
    if kind == "phone":
        return 1 if 8 <= len(digits) <= 15 else -1
    if kind == "secret":
        return 1 if digits and not span.isdigit() and len(set(span)) > 6 else -1
    if kind == "iban":
        own = span.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1 else -1
    if kind == "birth_date":
        return 1 if born(span) else -1
    return 0


def votes(text: str, kind: str, a: int, b: int, base: bool) -> list[int]:
    """What each of LABELERS says of the span: 1 personal data, -1 not, 0 nothing."""
    span, digits = text[a:b], re.sub("[^0-9]", "", text[a:b])
    shape = shape_vote(kind, span, digits, base)
    check = check_vote(kind, span, digits, base)
    if kind == "email":
        listed = 1 if span.rsplit(".", 1)[-1].lower() in TOP_DOMAINS else 0
    elif kind == "phone":
        listed = 0 if span[0] != "+" else 1 if any(digits[:k] in CALLING_CODES for k in (1, 2, 3)) else -1
    elif kind == "ip":
        listed = -1 if span.startswith(("0.", "127.", "255.")) else 0
    elif kind == "name":
        first = span.split(" ")[0].lower()
        listed = 1 if first in FIRST_NAMES else -1 if first in NO_NAMES else 0
    else:
        listed = -1 if digits and len(set(digits)) <= 2 else 0
    near = {w.lower() for w in WORDS.findall(text[max(0, a - CONTEXT) : a])[-4:]}
    context = 1 if near & CUES[kind] and kind not in CUED else -1 if near & AGAINST else 0
    before, after = text[a - 1 : a], text[b : b + 1]
    around = -1 if before.isalnum() or after.isalnum() else 1 if before and before in ":=<\"'(" else 0
    return [shape, check, listed, context, around]


def features(text: str, kind: str, a: int, b: int) -> list[int]:
    """Hashed features of the span: kind, shape, length and the words around it."""
    shape = re.sub("[A-Z]+", "A", re.sub("[a-zß-ÿ]+", "a", re.sub("[0-9]+", lambda m: f"9{min(len(m[0]), 20)}", text[a:b])))[:60]
    left, right = WORDS.findall(text[max(0, a - CONTEXT) : a])[-2:], WORDS.findall(text[b : b + CONTEXT])[:1]
    own = [f"k={kind}", f"s={kind}:{shape}", f"n={kind}:{(b - a).bit_length()}", f"b={kind}:{text[a - 1 : a]}", f"e={kind}:{text[b : b + 1]}"]
    own += [f"l={kind}:{w.lower()}" for w in left] + [f"r={kind}:{w.lower()}" for w in right]
    return sorted({zlib.crc32(x.encode()) % FEATURES for x in own})


FOUND = "base array<struct<kind: string, start: int, end: int>>, candidates array<struct<kind: string, start: int, end: int, base: boolean, votes: string, features: array<int>>>"
_SPAN = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
_TYPES = [pa.list_(pa.struct(_SPAN)), pa.list_(pa.struct([*_SPAN, ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))]


def candidates(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, base spans, and all candidates with votes and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_base, all_found = [], []
            for text in b["text"]:
                text = text.as_py() or ""
                base, more = spans_of(text)
                all_base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in base])
                all_found.append([{"kind": k, "start": x, "end": y, "base": own, "votes": "".join("-0+"[v + 1] for v in votes(text, k, x, y, own)), "features": features(text, k, x, y)} for own, group in ((True, base), (False, more)) for k, x, y in group])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(all_base, _TYPES[0]), pa.array(all_found, _TYPES[1])], names=["doc_id", "base", "candidates"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FOUND}")


def estimate(patterns: list[tuple[str, str, int]], rounds: int = 50) -> tuple[np.ndarray, dict[tuple[str, str], float]]:
    """Reliability of each labeler, and the probability of each (kind, votes), from their counts.

    EM for votes that are independent given the truth. Reliabilities start at 0.8 and kinds at
    even odds; pseudo-counts of a twentieth of all votes hold them near that where data says little.
    """
    v = np.array([["-0+".index(c) - 1 for c in p[1]] for p in patterns], float).reshape(len(patterns), len(LABELERS))
    n, kinds = np.array([p[2] for p in patterns], float), sorted({p[0] for p in patterns})
    kind = np.array([kinds.index(p[0]) for p in patterns], int)
    right, prior = np.full(len(LABELERS), 0.8), np.full(len(kinds), 0.5)
    p = np.zeros(len(patterns))
    for _ in range(rounds if len(patterns) else 0):
        odds = np.log(prior[kind] / (1 - prior[kind])) + v @ np.log(right / (1 - right))
        p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        weight = n.sum() / 20 + 1
        agree = ((v > 0) * p[:, None] + (v < 0) * (1 - p[:, None])) * n[:, None]
        voted = (v != 0) * n[:, None]
        right = np.clip((agree.sum(0) + 0.8 * weight) / (voted.sum(0) + weight), 0.55, 0.99)
        prior = np.array([((p * n)[kind == k].sum() + 0.5 * weight) / (n[kind == k].sum() + weight) for k in range(len(kinds))])
    return right, {(a, b): float(x) for (a, b, _), x in zip(patterns, p, strict=True)}


def train(sample: list[tuple[list[int], float]], rounds: int = 200, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic model of hashed binary features, the last one the constant, by AdaGrad on soft labels."""
    w = np.zeros(FEATURES + 1)
    if not sample:
        return w
    row = np.repeat(np.arange(len(sample)), [len(f) for f, _ in sample])
    col, y = np.array([i for f, _ in sample for i in f], int), np.array([p for _, p in sample])
    seen = np.full(FEATURES + 1, 1e-8)
    for _ in range(rounds):
        apart = 1 / (1 + np.exp(-(np.bincount(row, w[col], len(sample)) + w[-1]))) - y
        g = np.append(np.bincount(col, apart[row], FEATURES), apart.sum()) / len(sample) + ridge * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def fit(found: DataFrame, fit_candidates: int = FIT_CANDIDATES) -> tuple[np.ndarray, np.ndarray]:
    """(reliabilities, classifier weights) from ``candidates``. What reaches the driver is bounded: vote patterns, and the sample."""
    each = found.select("doc_id", F.explode("candidates").alias("c")).select("doc_id", "c.*")
    counts = each.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes")
    right, likely = estimate([(r["kind"], r["votes"], r["n"]) for r in counts.collect()])
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("h", "votes"))
    each = each.select(F.xxhash64("doc_id", "kind", "start", "end").alias("h"), "kind", "votes", "features")
    sample = each.withColumn("nth", nth).filter(F.col("nth") <= fit_candidates // len(KINDS)).orderBy("h", "kind", "votes").collect()
    return right, train([(r["features"], likely[r["kind"], r["votes"]]) for r in sample])


def find(docs: DataFrame, threshold: float = 0.5, fit_candidates: int = FIT_CANDIDATES, keep: list[str] | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found.

    The counts and base_sha256 are those of the base rules; spans joins all spans as
    kind:start:end with commas, by kind as in KINDS, then start, in code points, end exclusive.
    found: all spans as structs. Added spans overlap no base span and none of higher probability.
    Ties go to the first start, then kind. A null text counts as empty; repeated rows get equal
    spans; an empty table gives no rows; other columns of docs are not read. Time and memory of a
    text follow its length and its candidates.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = materialise(candidates(docs), "candidates", keep)
    _, weights = fit(found, fit_candidates)
    order = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for base, more in zip(b["base"].to_pylist(), b["candidates"].to_pylist(), strict=True):
                spans = [(s["kind"], s["start"], s["end"]) for s in base]
                text = ",".join(f"{k}:{x}:{y}" for k, x, y in spans)
                scored = [(1 / (1 + np.exp(-(weights[c["features"]].sum() + weights[-1]))), c) for c in more if not c["base"]]
                taken = covered(spans)
                for p, c in sorted(scored, key=lambda s: (-s[0], s[1]["start"], order[s[1]["kind"]])):
                    if p >= threshold and not touches(taken, c["start"], c["end"]):
                        insort(taken, (c["start"], c["end"]))
                        spans.append((c["kind"], c["start"], c["end"]))
                n = [sum(s["kind"] == k for s in base) for k in BASE]
                spans.sort(key=lambda s: (order[s[0]], s[1]))
                rows.append((*n, hashlib.sha256(text.encode()).hexdigest(), ",".join(f"{k}:{x}:{y}" for k, x, y in spans), [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans]))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + _TYPES[:1]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "found"])

    return found.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<struct<kind: string, start: int, end: int>>")
