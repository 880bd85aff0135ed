"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds disguised spans.

Base spans are the leftmost non-overlapping matches of each kind's pattern that pass its check; they are found in linear
time and always stay. The field reads the surroundings of digits, ``@`` and bracketed ``at``: text is cut into atoms
(runs of letters, digits or blanks, a bracketed ``at`` or ``dot``, other characters), a candidate is a whole span of at most
``LONGEST`` atoms and ``LONGEST_TEXT`` characters, and features of the whole span (digits, separators, checks such as Luhn,
its neighbours) score it for every kind. Dynamic programming over spans gives the probability of every candidate under all
ways to cut the text and the best cut; spans of the best cut with a probability of at least ``SURE`` that overlap no base
span are added.

A long stretch is read in pieces of ``PIECE`` characters that overlap by more than the longest candidate on either side, and
a span belongs to the piece that it begins in, so time is linear in the text and memory is bounded however many digits it has.
Features depend on a span's shape, its checks and its neighbours only, and are kept in a bounded table.

The field is trained by gradient on the likelihood: on at most ``EXAMPLES`` surroundings from a bounded sample of documents
with their base spans, and on copies in which the spans are written in disguise (``[at]``, ``[.]``, other separators, no plus
sign) or in which disguised spans of made-up data were put. Detection reads every whole text.

Defined results: null counts as empty; offsets are code points, ends exclusive; kinds are listed in the order email, ip,
card, phone; only 0 to 9 are digits (superscripts and digits of other scripts are other characters); a run of digits of any
length is read; an empty table gives an empty result; input columns named like a result column are replaced.
"""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import add_by_arrow, shielded

KINDS = ("email", "ip", "card", "phone")
#: Documents and stretches of them for fitting; the certainty asked for; atoms and characters of a candidate; characters
#: around a trigger, and of a piece.
SAMPLE, EXAMPLES, SURE, LONGEST, LONGEST_TEXT, REACH, PIECE = 2000, 700, 0.9, 24, 128, 48, 2048
_MOST_DIGITS, _KNOWN = 19, 1 << 16
_DIGITS = frozenset("0123456789")
_TWICE = {str(d): 2 * d - 9 * (d > 4) for d in range(10)}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ATOM = re.compile(r"[\[(](?:[aA][tT]|[dD][oO][tT])[\])]|[A-Za-z]+|[0-9]+| +|.", re.S)
_SIGN = re.compile(r"[\[(]at[\])]", re.I)
_HOST = re.compile(r"[A-Za-z0-9]\s*(?:\.|[\[(](?:dot|\.)[\])])\s*[A-Za-z]{2,}$", re.I)
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[\[(]at[\])]) ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(](?:dot|\.)[\])]) ?[A-Za-z0-9-]+)+", re.I)
_JOINT = frozenset("._%+-@")
_SHAPE = str.maketrans("0123456789", "0" * 10)
_TRIGGER = re.compile(r"[0-9]+|@|[\[(]at[\])]", re.I)

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    """Whether a run of digits is at most 255; leading zeros do not count, and long runs are never made numbers."""
    own = part.lstrip("0")
    return len(own) < 3 or len(own) == 3 and own <= "255"


def base_spans(text: str) -> list[Span]:
    """Base matches by start, then kind in the order of KINDS."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        if "." in text:
            for m in _CHAIN.finditer(text):
                parts = m[0].split(".")
                pos = m.start()
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    size = sum(map(len, four)) + 3
                    if all(map(_octet, four)):
                        out.append((pos, pos + size, "ip"))
                    pos += size + 1
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def regions(text: str) -> list[tuple[int, int]]:
    """Surroundings of digits, ``@`` and bracketed ``at``, merged; they end at line breaks or blanks where possible."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        lo = max(lo, text.rfind("\n", lo, m.start()) + 1)
        cut = text.find("\n", m.end(), hi)
        hi = cut if cut >= 0 else hi
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


_BUCKETS = (0, 3, 6, 8, 9, 11, 12, 15, 16, 19)
_NAMES = 49


def features(s: str, before: str, after: str) -> np.ndarray:
    """Features of a whole candidate span and the characters beside it."""
    digits = "".join(c for c in s if c in _DIGITS)
    groups = re.findall(r"[0-9]+", s)
    return _features(s, before, after, len(digits) >= 12 and luhn(digits), len(groups) == 4 and all(len(g) <= 3 and _octet(g) for g in groups))


def _features(s: str, before: str, after: str, card: bool, address: bool) -> np.ndarray:
    """The same from the checks' results and a text whose digits may be masked."""
    x = np.zeros(_NAMES)
    groups = re.findall(r"[0-9]+", s)
    n, dots, blanks = sum(map(len, groups)), s.count("."), s.count(" ")
    x[0] = 1
    x[1 + sum(n > b for b in _BUCKETS)] = 1
    x[12 + min(4, dots)] = 1
    x[17 + min(3, blanks)] = 1
    at = s.count("@")
    x[21] = at == 1
    x[22] = bool(_SIGN.search(s))
    x[23] = at > 1
    x[24], x[25], x[26], x[27] = s[0] == "+", s[0] == "(", s[0] in _DIGITS, s[0].isalpha()
    x[28], x[29] = s[-1] in _DIGITS, s[-1].isalpha()
    x[30], x[31] = card, address
    x[32] = len(groups) >= 2 and len(groups[-1]) == 4 and len(groups[-2]) == 3
    letters = any(c.isalpha() for c in s)
    x[33] = letters and not (x[21] or x[22])
    x[34], x[35] = before.isalnum(), after.isalnum()
    rest = re.sub(r"[0-9]", "", s)
    x[36] = bool(rest) and not rest.strip(" ()+.-")
    x[37] = bool(rest) and not rest.strip(" -._")
    x[38] = bool(rest) and not rest.strip(" .[]")
    x[39] = not rest
    x[40] = len(groups) == 4 and all(len(g) == 4 for g in groups)
    x[41] = bool(_HOST.search(s))
    x[42] = any(c in s for c in '\n,;!="')
    x[43], x[44] = before in "+.-_@%", after in "-_@%" and after != ""
    x[45] = "(" in s and ")" in s and len(groups) >= 3
    x[46] = s.count("(") != s.count(")") or s.count("[") != s.count("]")
    x[47] = bool(_ADDRESS.fullmatch(s))
    x[48] = bool(x[47]) and before not in _JOINT and (after not in _JOINT or after in ". ")
    return x


class Lattice:
    """Candidate spans of a stretch of text, with their features; ``known`` keeps the features of shapes met before."""

    def __init__(self, text: str, lo: int, hi: int, known: dict | None = None):
        known = {} if known is None else known
        part = text[lo:hi]
        starts = [m.start() for m in _ATOM.finditer(part)] + [hi - lo]
        n = len(starts) - 1
        atoms = [part[starts[k] : starts[k + 1]] for k in range(n)]
        number = [a[0] in _DIGITS for a in atoms]
        sign = [a == "@" or _SIGN.fullmatch(a) is not None for a in atoms]
        opens = [a[0].isalnum() or a in "+(" for a in atoms]
        closes = [a[0].isalnum() or a == ")" for a in atoms]
        stops = [a in "\n;,!" for a in atoms]
        shape = part.translate(_SHAPE)
        self.at = [a + lo for a in starts]
        # Luhn sums of any run of digits from sums over all digits, plain at even places and doubled at odd ones, and the reverse
        plain, doubled, place = [0], [0], [0]
        for a, is_number in zip(atoms, number, strict=True):
            if is_number and len(a) <= LONGEST_TEXT:
                for c in a:
                    own, twice = int(c), _TWICE[c]
                    even = len(plain) % 2
                    plain.append(plain[-1] + (own if even else twice))
                    doubled.append(doubled[-1] + (twice if even else own))
            place.append(len(plain) - 1)
        self.spans: list[tuple[int, int]] = []
        rows: list[np.ndarray] = []
        for i in range(n):
            if not opens[i] or len(atoms[i]) > LONGEST_TEXT:
                continue
            begin, digits, signs, groups = starts[i], 0, 0, 0
            before = text[lo + begin - 1] if lo + begin else ""
            before = "0" if before in _DIGITS else before
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                a = atoms[j - 1]
                end = starts[j]
                if stops[j - 1] or end - begin > LONGEST_TEXT:
                    break
                if number[j - 1]:
                    digits += len(a)
                    groups += 1
                signs += sign[j - 1]
                if signs > 1 or not signs and digits > _MOST_DIGITS:
                    break  # no kind has more
                if not closes[j - 1] or not signs and digits < 4:
                    continue
                after = text[lo + end] if lo + end < len(text) else ""
                x, y = place[i], place[j]
                sums = plain if y % 2 else doubled
                card = digits >= 12 and (sums[y] - sums[x]) % 10 == 0
                address = groups == 4 and all(len(atoms[k]) <= 3 and _octet(atoms[k]) for k in range(i, j) if number[k])
                key = (shape[begin:end], before, "0" if after in _DIGITS else after, card, address)
                x = known.get(key)
                if x is None:
                    x = _features(*key)
                    if len(known) < _KNOWN:
                        known[key] = x
                self.spans.append((i, j))
                rows.append(x)
        self.x = np.array(rows).reshape(-1, _NAMES)
        self.n = n

    def marginals(self, w: np.ndarray) -> tuple[np.ndarray, float]:
        """Probabilities (span, kind), and the log of the sum over all segmentations."""
        score = self.x @ w.T
        if not self.spans:
            return np.zeros((0, len(KINDS))), 0.0
        own = np.logaddexp.reduce(score, axis=1).tolist()
        ends: dict[int, list[int]] = {}
        begins: dict[int, list[int]] = {}
        for k, (i, j) in enumerate(self.spans):
            ends.setdefault(j, []).append(k)
            begins.setdefault(i, []).append(k)
        forward, backward = [0.0] * (self.n + 1), [0.0] * (self.n + 1)
        for j in range(1, self.n + 1):
            f = forward[j - 1]
            if j in ends:
                f = _log_sum([f, *(forward[self.spans[k][0]] + own[k] for k in ends[j])])
            forward[j] = f
        for i in range(self.n - 1, -1, -1):
            f = backward[i + 1]
            if i in begins:
                f = _log_sum([f, *(backward[self.spans[k][1]] + own[k] for k in begins[i])])
            backward[i] = f
        i, j = np.array(self.spans).T
        return np.exp(score + (np.array(forward)[i] + np.array(backward)[j] - forward[-1])[:, None]), forward[-1]

    def best(self, w: np.ndarray) -> list[tuple[int, int]]:
        """(candidate, kind) of the likeliest segmentation."""
        if not self.spans:
            return []
        score = self.x @ w.T
        most, kind = score.max(1).tolist(), score.argmax(1).tolist()
        value, back = [0.0] * (self.n + 1), [None] * (self.n + 1)
        ends: dict[int, list[int]] = {}
        for k, (_, j) in enumerate(self.spans):
            ends.setdefault(j, []).append(k)
        for j in range(1, self.n + 1):
            value[j] = value[j - 1]
            for k in ends.get(j, ()):
                v = value[self.spans[k][0]] + most[k]
                if v > value[j]:
                    value[j], back[j] = v, k
        out, j = [], self.n
        while j:
            k = back[j]
            if k is None:
                j -= 1
            else:
                out.append((k, kind[k]))
                j = self.spans[k][0]
        return out[::-1]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def _made_up(rng: random.Random, kind: str) -> str:
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    if kind == "email":
        return f"{word()}.{d(2)}@{word()}.{rng.choice(('com', 'org', 'net', 'example.com'))}"
    if kind == "ip":
        return ".".join(str(rng.randint(1, 255)) for _ in range(4))
    if kind == "card":
        body = "4" + d(14)
        return body + next(c for c in "0123456789" if luhn(body + c))
    return f"+{rng.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}"


def disguised(rng: random.Random, kind: str, span: str) -> str:
    """The span as someone who hides it from plain patterns would write it."""
    if kind == "email":
        at, dot = rng.choice((("[at]", "."), (" [at] ", "."), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]")))
        local, _, domain = span.partition("@")
        return local + at + domain.replace(".", dot)
    digits = "".join(c for c in span if c in _DIGITS)
    if kind == "ip":
        return span.replace(".", rng.choice(("[.]", " . ", "[.]")))
    if kind == "card":
        return rng.choice((".", "_", " - ", "  ")).join(digits[k : k + 4] for k in range(0, len(digits), 4))
    area, mid, end = digits[-10:-7] or "555", digits[-7:-4], digits[-4:]
    return rng.choice((f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"1 ({area}) {mid}-{end}", f"{area}.{mid}.{end}"))


class Field:
    """Weights (kind, feature) of the semi-Markov field."""

    def __init__(self, w: np.ndarray):
        self.w = w
        self._known: dict = {}

    def __getstate__(self):
        return self.w

    def __setstate__(self, w):
        self.__init__(w)

    def spans(self, text: str, base: list[Span] | None = None, piece: int = PIECE) -> list[Span]:
        """Base spans and the spans that the field adds, by start, then kind."""
        base = base_spans(text) if base is None else base
        added: list[Span] = []
        apart = _Covered(base)
        done = 0
        for lo, hi in regions(text):
            for a in range(lo, hi, piece):
                b = min(hi, a + piece)
                for s, e, kind in self._sure(text, max(lo, a - 2 * LONGEST_TEXT), min(hi, b + 2 * LONGEST_TEXT)):
                    if a <= s < b and s >= done and not apart.overlaps(s, e):
                        added.append((s, e, kind))
                        done = e
        return sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))

    def _sure(self, text: str, lo: int, hi: int) -> list[Span]:
        lattice = Lattice(text, lo, hi, self._known)
        best = lattice.best(self.w)
        if not best:
            return []
        p, _ = lattice.marginals(self.w)
        return [(lattice.at[lattice.spans[k][0]], lattice.at[lattice.spans[k][1]], KINDS[y]) for k, y in best if p[k, y] >= SURE]


class _Covered:
    """Whether a span overlaps one of many; asked from left to right."""

    def __init__(self, spans: list[Span]):
        self.spans, self.k = sorted((a, b) for a, b, _ in spans), 0
        self.longest = max((b - a for a, b in self.spans), default=0)

    def overlaps(self, start: int, end: int) -> bool:
        while self.k < len(self.spans) and self.spans[self.k][0] + self.longest <= start:
            self.k += 1
        k = self.k
        while k < len(self.spans) and self.spans[k][0] < end:
            if self.spans[k][1] > start:
                return True
            k += 1
        return False


def train_field(stretches: list[str], seed: int = 11, epochs: int = 12, most: int = EXAMPLES) -> Field:
    """From stretches of text: as they are, with their spans in disguise, and with made-up spans put in."""
    rng = random.Random(seed)
    stretches = [s for s in stretches if s.strip()] or ["a b c"]
    rng.shuffle(stretches)
    examples: list[tuple[str, list[Span]]] = []
    for k, s in enumerate(stretches[:most]):
        spans = base_spans(s)
        clear = [x for x in spans if not any(x != y and x[0] < y[1] and y[0] < x[1] for y in spans)]
        if len(clear) == len(spans):
            examples.append((s, spans))
        if k % 2 and len(clear) == len(spans):
            kind = KINDS[k // 2 % len(KINDS)]
            own = spans[0] if spans else None
            if own:
                kind, hidden, a, b = own[2], disguised(rng, own[2], s[own[0] : own[1]]), own[0], own[1]
            else:
                a = b = rng.choice([m.start() for m in re.finditer(" ", s)] or [0])
                hidden = disguised(rng, kind, _made_up(rng, kind))
            lead = "" if own or not a else " "
            tail = "" if own or a else " "
            new = s[:a] + lead + hidden + tail + s[b:]
            shift = len(new) - len(s)
            a += len(lead)
            examples.append((new, [(a, a + len(hidden), kind), *((x + shift, y + shift, z) for x, y, z in spans[1:] if own)]))
    for k in range(160):  # the sample may hold no personal data at all
        kind = KINDS[k % 4]
        hidden = _made_up(rng, kind)
        hidden = disguised(rng, kind, hidden) if k % 8 >= 4 else hidden
        s = rng.choice(stretches)
        words = [x for x in s.split() if x.isalpha()][:6] or ["a"]
        lead = " ".join(words[:3]) + " "
        examples.append((lead + hidden + " " + " ".join(words[3:]), [(len(lead), len(lead) + len(hidden), kind)]))
    lattices = []
    known: dict = {}
    for text, spans in examples:
        lattice = Lattice(text, 0, len(text), known)
        place = {(lattice.at[i], lattice.at[j]): k for k, (i, j) in enumerate(lattice.spans)}
        gold = [(place[a, b], KINDS.index(y)) for a, b, y in spans if (a, b) in place]
        if len(gold) == len(spans) and lattice.spans:
            lattices.append((lattice, gold))
    w, squares = np.zeros((len(KINDS), _NAMES)), np.full((len(KINDS), _NAMES), 1e-3)
    w[:, 0] = -4
    for _ in range(epochs):
        rng.shuffle(lattices)
        for lattice, gold in lattices:
            p, _ = lattice.marginals(w)
            g = -p.T @ lattice.x - 1e-4 * w
            for k, y in gold:
                g[y] += lattice.x[k]
            squares += g * g
            w += 0.4 * g / np.sqrt(squares)
    return Field(w)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """A field trained on stretches from at most ``sample`` documents that hold a digit or an ``@``."""
    near = docs.filter(F.col("text").rlike("[0-9@]"))
    n = near.count()
    draw = F.pmod(F.xxhash64("text", F.lit("pii")), F.lit(1 << 30))
    share = min(1.0, 0.9 * sample / n) if n else 1.0
    around = F.regexp_extract_all("text", F.lit(r"[^\n]{0,48}[0-9@][^\n]{0,64}"), F.lit(0))
    found = near.filter(draw < int(share * (1 << 30))).select(F.explode(F.array_distinct(around)).alias("s")).distinct()
    # an order that does not depend on partitions; copies of a text count once
    rows = found.orderBy(F.xxhash64("s"), "s").limit(3 * sample).collect()
    return train_field(sorted({r.s for r in rows}))


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])
_FIELDS = [T.StructField("base_spans", T.ArrayType(_SPAN)), T.StructField("all_spans", T.ArrayType(_SPAN))]


def find_pii(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with base_spans and all_spans: (start, end, kind) in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.schema.names.index("text")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        own, every = [], []
        for text in batch.column(at).to_pylist():
            base = base_spans(text or "")
            spans = shared.value.spans(text, base) if text and _TRIGGER.search(text) else base
            own.append([{"start": a, "end": b, "kind": k} for a, b, k in base])
            every.append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
        return [pa.array(own, kind), pa.array(every, kind)]

    return add_by_arrow(docs, _FIELDS, compute)


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets; overlapping spans are one."""
    return shielded(docs, lambda own: _redacted(find_pii(own, field)))


def _redacted(found: DataFrame) -> DataFrame:
    at, spans = found.schema.names.index("text"), found.schema.names.index("all_spans")

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for text, own in zip(batch.column(at).to_pylist(), batch.column(spans).to_pylist(), strict=True):
            if own:
                parts, last = [], 0
                for s in own:
                    if s["start"] >= last:
                        parts += [text[last : s["start"]], f"<{s['kind']}>"]
                    last = max(last, s["end"])
                text = "".join([*parts, text[last:]])
            out.append(text)
        return [pa.array(out, pa.string())]

    return add_by_arrow(found, [T.StructField("text", T.StringType())], compute)


def _said(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_semi_markov_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs, fit(docs))
    kinds = F.col("base_spans")["kind"]
    counts = [F.size(kinds).cast("long") - F.size(F.array_remove(kinds, k)).cast("long") for k in KINDS]
    counts = [c.alias(f"n_{k}") for c, k in zip(counts, KINDS, strict=True)]
    return found.select("doc_id", *counts, F.sha2(_said("base_spans").cast("binary"), 256).alias("base_sha256"), _said("all_spans").alias("spans"))
