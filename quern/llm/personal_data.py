"""Personal data: candidate spans of generators, boosted trees over format and context, calibrated thresholds.

Spans that satisfy a kind's rule are base spans and stay.  Wider generators propose more spans,
which may overlap; gradient-boosted trees score them by their format and the words around them;
scores are calibrated per kind by isotonic regression on held-out documents, and spans that are
likely enough are added, the likeliest of those that overlap.

No table labels personal data, so the trees learn from the corpus itself: base spans written another
way (other separators, spelled-out marks, no prefix) in their own surroundings are what is to be found,
and numbers of the same shape that fail the checks, as well as all that the generators propose and no
rule confirms, are what isn't.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spark_io import absent, table, written

KINDS = ("email", "ip", "card", "phone")

# The base rules; an address's digits are read as runs of groups, four of which are a match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_DIGITS = re.compile("[0-9]+")
_NOT_DIGIT = re.compile("[^0-9]+")

# The generators of further spans.
_AT = re.compile(r"@|(?<=[\s(\[{])[aA][tT](?=[\s)\]}])")
_AT_LEFT, _AT_RIGHT = re.compile(r"\s{0,2}[(\[{]\s?\Z|\s{1,2}\Z"), re.compile(r"\s?[)\]}]\s{0,2}|\s{1,2}")
_DOT = r"(?:\s?[(\[{]\s?(?:dot|\.)\s?[)\]}]\s?|\s{1,2}dot\s{1,2}|\s\.\s|\.)"
_SPELLED = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}", re.I)
_NUMBERS = re.compile(r"[0-9(][0-9 ().\-/_]*+")
_SIX = re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]*:)[0-9A-Fa-f:]{3,45}(?![0-9A-Za-z:])")
_FOUR = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\s?[(\[]\s?(?:dot|\.)\s?[)\]]\s?|\s\.\s|\sdot\s)[0-9]{{1,3}}){{3}}(?![0-9.])", re.I)

# Words that often stand before personal data, and before numbers that are none.
_CONTEXT = {
    "email": ("mail", "contact", "write", "reach", "inbox"),
    "ip": ("ip", "host", "server", "address", "ping", "router"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "amex"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "whatsapp", "ring"),
}
_IDLE = ("version", "page", "isbn", "invoice", "total", "order", "years", "date", "serial", "$", "score")
_BEFORE, _AFTER = 40, 12


@dataclass(frozen=True)
class BoostConfig:
    """``documents``: with digits or signs of addresses, that examples are made from, at most; ``examples``: to learn from, at
    most, and ``each``: of one document, ``variants`` of one base span; ``least``: examples of either sort that a kind needs; ``accept``: how likely an added span must be."""

    documents: int = 2000
    examples: int = 12_000
    each: int = 60
    variants: int = 12
    least: int = 40
    rounds: int = 40
    depth: int = 4
    rate: float = 0.3
    bins: int = 16
    accept: float = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _card_ok(s: str) -> bool:
    digits = _NOT_DIGIT.sub("", s)
    return 14 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(s: str) -> bool:
    return 10 <= len(_NOT_DIGIT.sub("", s)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base spans, sorted; leftmost and non-overlapping in each kind; in time linear in the text."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((s, 0, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", last)
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            groups = [g.span() for g in _DIGITS.finditer(text, m.start(), m.end())]
            for i in range(0, len(groups) - 3, 4):
                s, e = groups[i][0], groups[i + 3][1]
                if _ip_ok(text[s:e]):
                    out.append((s, 1, e))
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() > 13 and _card_ok(m[0])]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if _phone_ok(m[0])]
    out.sort()
    return out


def _six_ok(s: str) -> bool:
    groups = s.split(":")
    return s.count("::") <= 1 and ":::" not in s and all(len(g) <= 4 for g in groups) and (len(groups) == 8 if "::" not in s else 3 <= len(groups) <= 8)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the spans that the generators propose, sorted; they may overlap."""
    out = set()
    for m in _AT.finditer(text):
        left, right = _AT_LEFT.search(text, max(0, m.start() - 4), m.start()), _AT_RIGHT.match(text, m.end())
        if left is None and right is None:  # a sign by itself is for the base rule
            continue
        s = mark = left.start() if left else m.start()
        while s > 0 and mark - s < 64 and text[s - 1] in _LOCAL:
            s -= 1
        if s < mark and (d := _SPELLED.match(text, right.end() if right else m.end())):
            out.add((s, 0, d.end()))
    if ":" in text:
        out |= {(m.start(), 1, m.end()) for m in _SIX.finditer(text) if _six_ok(m[0])}
    if not _DIGIT.search(text):
        return sorted(out)
    if "." in text or "dot" in text:
        out |= {(m.start(), 1, m.end()) for m in _FOUR.finditer(text)}
    for m in _NUMBERS.finditer(text):
        if m.end() - m.start() < 7:
            continue
        before = text[m.start() - 1] if m.start() else " "
        groups = [g.span() for g in _DIGITS.finditer(text, m.start(), m.end())]
        for i, (s, _) in enumerate(groups):
            if i == 0 and (before.isalnum() or before == "+" or (before in ".,:" and m.start() > 1 and text[m.start() - 2].isdigit())):
                continue
            digits = 0
            for j in range(i, min(i + 6, len(groups))):
                lo, hi = groups[j]
                digits += hi - lo
                if digits > 19 or (j > i and lo - groups[j - 1][1] > 3):
                    break
                if j + 1 == len(groups) and hi < len(text) and text[hi].isalnum():
                    break
                start = s - 1 if s > m.start() and text[s - 1] == "(" and ")" in text[s:hi] else s
                if 7 <= digits <= 15:
                    out.add((start, 3, hi))
                if 13 <= digits <= 19:
                    out.add((s, 2, hi))
    return sorted(out)


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """What the trees see of a span: its format, then its context."""
    s = text[start:end]
    digits = _NOT_DIGIT.sub("", s)
    runs = [len(x) for x in _DIGITS.findall(s)]
    apart = _DIGITS.sub("0", s).strip("0(").split("0")
    before, after = text[max(0, start - _BEFORE) : start].lower(), text[end : end + _AFTER]
    lower = s.lower()
    tail = re.split(r"[^a-z0-9]+", lower)[-1]
    parts = [int(x) if len(x) < 7 else 1 << 20 for x in _DIGITS.findall(s)]
    return [
        float(kind), float(len(s)), float(len(digits)), float(sum(c.isalpha() for c in s)), float(s.count(".")), float(s.count("-")), float(s.count(" ")), float(s.count("/") + s.count("_")),
        float("(" in s), float(len(runs)), float(max(runs, default=0)), float(min(runs, default=0)), float(len(set(runs))), float(luhn(digits) if digits else 0), float(digits[:1] == "0"), float(len(set(digits))),
        float(digits[:2] in ("19", "20")), float(digits[:2] in ("97", "00")), float(runs[-1] if runs else 0), float(len(set(apart))), float(max(parts, default=0) <= 255), float("::" in s), float(s.count(":")),
        float(sum(c in "abcdef" for c in lower)), float(bool(re.search(r"[(\[{]\s?(?:at|@)", lower))), float(" at " in lower), float(lower.count("dot")), float(len(tail)), float(tail.isalpha()),
        float(before[-1:].strip() in ("", ":", "(", "=")), float(bool(re.search(r"[0-9][ ./()_-]{1,3}$", before))), float(bool(re.match(r"[ ./()_-]{1,3}[0-9]", after))),
        *[float(any(w in before for w in words)) for words in _CONTEXT.values()],
        float(any(w in before for w in _IDLE)),
    ]


#: Marks a spelling that only its surroundings tell from a number of another sort.
PLAIN = "\0"


def _otherwise(kind: int, s: str, pick, num) -> tuple[str, bool]:
    """A base span written another way, or something of that shape that is none, and whether it is personal data."""
    good = bool(int(num(1)) % 2)
    digits = _NOT_DIGIT.sub("", s)
    if kind == 0:
        local, _, domain = s.partition("@")
        words = [w for w in re.split(r"[^A-Za-z]+", s) if w] or ["a"]
        if good:  # names and domains of other makes too, so that the marks decide and not the corpus's own names
            local = pick([local, local, pick(words), f"{pick(words)}.{pick(words)}", f"{pick(words)}_{num(1)}"])
            domain = pick([domain, domain, f"{pick(words)}.{pick(words)}", f"{pick(words)}{num(1)}.{pick(words[-1:])}", f"{pick(words)}-{pick(words)}.{pick(words)}.{pick(words[-1:])}"])
            at, dot = pick([(" (at) ", " (dot) "), ("(at)", "."), ("[at]", "[dot]"), (" [at] ", "."), (" at ", " dot "), (" at ", "."), (" @ ", "."), (" AT ", " DOT "), ("(at)", "(dot)"), ("@ ", "."), ("{at}", "{dot}")])
            return f"{local}{at}{domain.replace('.', dot)}", True
        other = [pick(words).capitalize(), num(1), num(2)]
        return pick([f"{pick(words)} at {pick(words)}.{pick(other)}", f"{num(2)} (at) {num(2)}.{num(2)}", f"{local} at {num(1)}.{num(2)}", f"{num(3)} @ {num(2)}.{num(2)}", f"{local} at {pick(words)}.{pick(words).capitalize()} {pick(words)}", f"{pick(words)} (at) {num(2)} . {num(2)}"]), False
    if kind == 1:
        parts = [int(x) for x in s.split(".")]
        if good:
            six = [f"{x:x}" for x in (0x2001, 0xDB8, parts[0] * 256 + parts[1], int(num(4)), parts[2] * 256 + parts[3], parts[0] * 256 + parts[3], int(num(4)), parts[1] * 256 + parts[2] + 4096)]
            return pick([s.replace(".", "[.]"), s.replace(".", "(.)"), s.replace(".", " . "), s.replace(".", "[dot]"), ":".join(six), f"2001:db8::{six[4]}", f"fe80::{six[2]}:{six[4]}", f"{six[0]}:{six[2]}::{six[7]}", f"{six[0]}:{pick(['db8', six[2]])}::{num(1)}", f"fe80::{six[2]}:{num(1)}", f"fe80::{num(1)}", f"{six[0]}:{six[1]}::{num(1)}"]), True
        return pick([".".join([num(3), str(300 + int(num(2))), num(2), num(1)]).replace(".", pick(["[.]", "(.)", " . "])), ":".join(num(2) for _ in range(8)), f"{pick('abcdef')}::{pick('abcdef')}", ":".join(num(1) for _ in range(8)), f"{num(1)} . {num(1)} . {num(1)} . {num(1)}"]), False
    if kind == 2:
        if not good:
            at = int(num(2)) % len(digits)
            digits = digits[:at] + str((int(digits[at]) + 1 + int(num(1)) % 9) % 10) + digits[at + 1 :]
        cuts = pick([[4, 8, 12], [4, 8, 12], [4, 10], [8], [6, 10]])
        return pick([".", "_", " - ", "  ", "/", ". "]).join(digits[a:b] for a, b in zip([0, *cuts], [*cuts, len(digits)], strict=True)), good and luhn(digits)
    n = digits[-10:]
    a, b, c = n[:3], n[3:6], n[6:]
    if good:
        return pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}){b}-{c}", f"0{a}/{b}{c}", f"00{digits[:-10] or '1'} {a} {b} {c}", f"0{a[:2]} {n[2:6]} {c}", f"{a}/{b}-{c}", f"{PLAIN}{n}", f"{PLAIN}0{n[1:]}"]), True
    year = str(1900 + int(num(2)))
    return pick([f"{year}-{num(2)}-{num(2)} {num(2)}", f"{year}-{int(year) + 5} {num(2)}", f"{num(2)}/{num(2)}/{year}", f"{num(1)}.{num(3)}.{num(3)}.{num(3)}", f"97{num(1)}-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(2)} {num(2)} {num(2)} {num(2)}", f"{num(3)}-{num(4)}", num(8), num(9), num(12), f"{num(5)}.{num(5)}"]), False


def examples(text: str, config: BoostConfig = BoostConfig()) -> list[tuple[list[float], bool]]:
    """Features and labels of candidates in a text, whose base spans are written otherwise one after another; the same for the same text."""
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "replace")))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    base = base_spans(text)
    out = []
    held = [(s, e) for s, _, e in base]
    natural = [c for c in candidates(text) if not _touches(held, c[0], c[2])]
    for i in rng.permutation(len(natural))[: config.each // 2]:
        out.append((features(text, *natural[i]), False))
    for i in rng.permutation(len(base)):
        s, kind, e = base[i]
        for _ in range(config.variants):
            if len(out) >= config.each:
                return out
            written_so, good = _otherwise(kind, text[s:e], pick, num)
            plain, written_so = written_so.startswith(PLAIN), written_so.removeprefix(PLAIN)
            told = good or int(num(1)) < 2
            if kind == 3 and good and int(num(1)) < (5 if plain else 2):
                good = told = False  # the same shape after a word for numbers of other sorts
            word = f"{pick(_CONTEXT[KINDS[kind]] if told else _IDLE)}{pick([' ', ': ', ' is '])}"
            lead = word if kind == 3 and (plain or not told) else pick(["", "", word])
            left = text[max(0, s - _BEFORE) : s] + lead
            snippet = left + written_so + text[e : e + _AFTER]
            a, b = len(left), len(left) + len(written_so)
            for lo, k, hi in candidates(snippet):
                if lo < b and a < hi:
                    out.append((features(snippet, lo, k, hi), good and k == kind and (lo, hi) == (a, b)))
    return out[: config.each]


def _touches(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    return any(s < end and start < e for s, e in spans)


# --- boosted trees: a full binary tree a round, as arrays of features, cuts (in order of nodes) and leaves


def boost(x: np.ndarray, y: np.ndarray, config: BoostConfig) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Trees of logistic gradient boosting, grown level by level on binned features."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, config.bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)  # bin b holds what is at most cut b
    trees, raw = [], np.zeros(len(y))
    for _ in range(config.rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros((1 << config.depth) - 1, np.int64), np.full((1 << config.depth) - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(config.depth):
            first, n = (1 << level) - 1, 1 << level
            best = np.full(n, 1e-6)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                at = (node - first) * (config.bins + 1) + binned[:, f]
                gs = np.bincount(at, g, n * (config.bins + 1)).reshape(n, -1).cumsum(1)
                hs = np.bincount(at, h, n * (config.bins + 1)).reshape(n, -1).cumsum(1)
                gl, hl = gs[:, : len(c)], hs[:, : len(c)]
                gr, hr = gs[:, -1:] - gl, hs[:, -1:] - hl
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                gain[(hl < 0.5) | (hr < 0.5)] = 0
                k = gain.argmax(1)
                more = gain[np.arange(n), k] > best
                best[more] = gain[np.arange(n), k][more]
                feature[first : first + n][more], cut[first : first + n][more] = f, c[k[more]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - ((1 << config.depth) - 1)
        values = -config.rate * np.bincount(leaf, g, 1 << config.depth) / (np.bincount(leaf, h, 1 << config.depth) + 1)
        trees.append((feature, cut, values))
        raw += values[leaf]
    return trees


def raw_scores(trees: list, x: np.ndarray) -> np.ndarray:
    raw = np.zeros(len(x))
    for feature, cut, values in trees:
        node = np.zeros(len(x), np.int64)
        while len(node) and node[0] < len(feature):
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        raw += values[node - len(feature)]
    return raw


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, chances): the nondecreasing steps that fit the labels best, each from its score on, by pooling adjacent violators."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # least score, sum, count
    for s, v in zip(scores[order], y[order], strict=True):
        blocks.append([s, float(v), 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, v2, n2 = blocks.pop()
            blocks[-1][1] += v2
            blocks[-1][2] += n2
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


@dataclass(frozen=True)
class Model:
    """``trees``, and for each kind ``cuts``: the least raw score of an added span (infinite: the kind had too few examples)."""

    trees: tuple
    cuts: tuple[float, ...]


def fit(x: np.ndarray, y: np.ndarray, held_out: np.ndarray, config: BoostConfig = BoostConfig()) -> Model:
    """Trees of the examples that aren't held out, and cuts where the calibrated chance on held-out ones reaches ``accept``."""
    cuts = [float("inf")] * len(KINDS)
    if not len(y) or not (~held_out).any():
        return Model((), tuple(cuts))
    trees = boost(x[~held_out], y[~held_out], config)
    raw = raw_scores(trees, x)
    for kind in range(len(KINDS)):
        own = x[:, 0] == kind
        test = own & held_out
        if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= config.least and test.any():
            least, chance = isotonic(raw[test], y[test])
            if (chance >= config.accept).any():
                cuts[kind] = max(0.0, float(least[np.argmax(chance >= config.accept)]))
    return Model(tuple(trees), tuple(cuts))


def _examples(config: BoostConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(zlib.crc32(str(key).encode()), i, x, float(y)) for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for i, (x, y) in enumerate(examples(text.as_py() or "", config))]
            if rows:
                doc, place, x, y = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(place, pa.int32()), pa.array(x, pa.list_(pa.float64())), pa.array(y)], ["doc", "place", "x", "y"])

    return run


def train(docs: DataFrame, config: BoostConfig = BoostConfig(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of a corpus, from a bounded sample: ``documents`` with the least hashes among those that hold digits of an address, ``each`` examples of one, ``examples`` in all.

    A quarter of the documents is held out to calibrate.  A corpus without base spans gives a model that adds none.
    """
    (key,) = absent(docs, "key")
    telling = F.col(text_col).rlike(r"@|\+[0-9]|[0-9]\.[0-9]|[0-9]{4}")
    ids = docs.where(telling & F.col(id_col).isNotNull()).select(F.col(id_col).alias(key)).distinct().orderBy(F.xxhash64(key), key).limit(config.documents)
    # config.documents rows at most
    texts = docs.join(F.broadcast(written(ids)), F.col(id_col) == F.col(key)).select(F.col(key).cast("string").alias("key"), F.col(text_col).alias("text"))
    rows = texts.mapInArrow(_examples(config), "doc long, place int, x array<double>, y double")
    found = rows.orderBy(F.xxhash64("doc", "place"), "doc", "place").limit(config.examples).collect()
    x, y = np.array([r["x"] for r in found]), np.array([r["y"] for r in found])
    return fit(x, y, np.array([r["doc"] % 4 == 0 for r in found], bool), config)


def added_spans(text: str, base: list[tuple[int, int, int]], model: Model) -> list[tuple[int, int, int]]:
    """The candidates that the model accepts, but for those within base spans; of overlapping ones of a kind the likeliest."""
    if not model.trees:
        return []
    ends = np.maximum.accumulate([e for _, _, e in base]) if base else np.zeros(0)
    starts = [s for s, _, _ in base]
    open_ = []
    for c in candidates(text):
        i = int(np.searchsorted(starts, c[0], "right"))
        if not (i and ends[i - 1] >= c[2]):
            open_.append(c)
    if not open_:
        return []
    raw = raw_scores(list(model.trees), np.array([features(text, *c) for c in open_]))
    good = [(r, c) for r, c in zip(raw.tolist(), open_, strict=True) if r >= model.cuts[c[1]]]
    out: list[tuple[int, int, int]] = []
    for kind in range(len(KINDS)):
        run: list[tuple[float, tuple[int, int, int]]] = []  # overlapping ones, one after another
        own = [x for x in good if x[1][1] == kind]
        for x in [*own, None]:
            if x is None or (run and x[1][0] >= max(c[2] for _, c in run)):
                taken: list[tuple[int, int, int]] = []
                for _, c in sorted(run, key=lambda z: (-z[0], z[1][0] - z[1][2], z[1])):
                    if not _touches([(s, e) for s, _, e in taken], c[0], c[2]):
                        taken.append(c)
                out += taken
                run = []
            if x is not None:
                run.append(x)
    return out


SPANS = "base array<struct<start: int, kind: string, end: int>>, spans array<struct<start: int, kind: string, end: int>>"


def _scan(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
        show = lambda spans: [{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans]
        for batch in batches:
            base, spans = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                found = base_spans(text)
                base.append(show(found))
                spans.append(show(sorted({*found, *added_spans(text, found, model)})))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(spans, kind)], ["key", "base", "spans"])

    return run


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, config: BoostConfig = BoostConfig()) -> DataFrame:
    """One row per row of ``docs``: id, ``base`` and ``spans`` (base ones and those the trees add).

    ``model`` is learned from ``docs`` where none is given.  Places count code points, ends are
    exclusive; spans are sorted by start, then kind as in KINDS.  An added span lies within no base
    span.  A null or empty text has none; rows with equal ids are scanned each by itself; other
    columns are ignored.
    """
    (key,) = absent(docs, "key")
    model = model or train(docs, config, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS `{key}`", f"`{text_col}`").mapInArrow(_scan(model), f"key {kind}, {SPANS}").withColumnRenamed("key", id_col)


def op2_boosted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_`` columns and ``base_sha256`` are of base spans; ``n_added`` and ``spans`` tell what the method adds."""
    found = personal_data(table(spark, sf_dir, "documents"))
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(show("base"), 256).alias("base_sha256"), show("spans").alias("spans"), added)


def brute_force(text: str) -> str:
    """The digest of the base spans, straight from the rules."""
    rules = [("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True), ("ip", _IP, _ip_ok), ("card", _CARD, _card_ok), ("phone", _PHONE, _phone_ok)]
    spans = sorted((m.start(), i, m.end()) for i, (_, p, ok) in enumerate(rules) for m in p.finditer(text or "") if ok(m[0]))
    return hashlib.sha256(",".join(f"{rules[k][0]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
