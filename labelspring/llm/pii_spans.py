"""Personal data by a semi-Markov conditional random field over a base of fixed patterns.

The base finds emails, IP numbers, cards and phones by pattern and check digits; its
spans always stay.  The model scores whole candidate segments (shape, digits, checks,
word before) and a dynamic program over segments of bounded length chooses borders
and types together.  It adds spans that the patterns miss, such as phones without
a plus or emails in words, where they touch no base span.  It looks at windows of
tokens around digits, @ and spelled dots only, of the whole text.

It is trained on a bounded sample: WINDOWS windows of base spans and other digits, some
of them rewritten without the mark that the pattern needs.

Defined cases: null and empty texts have no spans.  Spans are in code points, end
exclusive.  Repeated rows and null ids give a row each; an empty table trains no model
and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspring.llm.common import whole_text

KINDS = ("email", "ip", "card", "phone")
# The patterns of the base.
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

WINDOWS = 800  # training windows
DOCS = 400  # documents that they come from
EPOCHS = 6
AROUND = 16  # tokens on each side of an anchor
MAX_TOKENS = 24  # tokens of an entity
MAX_CHARS = 80
DIMENSIONS = 1 << 14
MARGIN = 2.0  # score of plain text per entity: only clear segments are added

_TOKEN = re.compile(r"[0-9]+|[^\W0-9]+|\s+|.", re.DOTALL)
_ANCHOR = re.compile(r"[0-9@]| dot ")
_DIGIT = re.compile(r"[0-9]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        found = EMAIL_DOMAIN.match(text, at)
        begin = at
        if found:
            while begin > done and text[begin - 1] in EMAIL_LOCAL:
                begin -= 1
        if begin < at:
            out.append((begin, found.end()))
            done = found.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """Spans by kind as listed, then start."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text) is None:
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p[-400:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def tokens_near_anchors(text: str) -> list[list[tuple[int, int]]]:
    """Windows of token borders, disjoint and in order."""
    if _ANCHOR.search(text) is None:
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    out: list[list[tuple[int, int]]] = []
    low = high = -1
    for i, (a, b) in enumerate(tokens):
        if text[a] in "0123456789@" or (text[a:b] == "dot" and text[a - 1 : b + 1] == " dot "):
            if high < 0 or i - AROUND > high:
                if high >= 0:
                    out.append(tokens[low : high + 1])
                low = max(0, i - AROUND)
            high = min(len(tokens) - 1, i + AROUND)
    if high >= 0:
        out.append(tokens[low : high + 1])
    return out


def _shape(segment: str) -> str:
    return re.sub(r"9+", "9", re.sub(r"[^\W0-9]+", "a", re.sub(r"[0-9]", "9", segment)))


def segment_features(text: str, begin: int, end: int) -> list[str]:
    segment = text[begin:end]
    digits = _digits(segment)
    before = re.search(r"(\w+)\W*\Z", text[max(0, begin - 24) : begin])
    parts = segment.split(".")
    return [
        "bias", f"shape={_shape(segment)}", f"digits={min(len(digits), 20)}", f"at={segment.count('@')}",
        f"spelled={' at ' in segment and ' dot ' in segment}", f"plus={segment[0] == '+'}",
        f"luhn={13 <= len(digits) <= 19 and luhn(digits)}",
        f"octets={len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)}",
        f"letters={any(c.isalpha() for c in segment)}", f"before={before[1].lower() if before else ''}",
        f"open={begin == 0 or not (text[begin - 1].isalnum() or text[begin - 1] in '.-_@+')}",
        f"closed={end == len(text) or not (text[end].isalnum() or text[end] in '-_@')}",
    ]


def candidates(text: str, window: list[tuple[int, int]]) -> list[tuple[int, int, list[str]]]:
    """(first token, end token, features) of the segments that may be entities."""
    out = []
    for i, (begin, _) in enumerate(window):
        if not (text[begin].isalnum() or text[begin] in "+("):
            continue
        n_digits, marked = 0, False
        for j in range(i, min(len(window), i + MAX_TOKENS)):
            a, b = window[j]
            if b - begin > MAX_CHARS or "\n" in text[a:b]:
                break
            n_digits += b - a if text[a].isdigit() and text[a] in "0123456789" else 0
            marked = marked or text[a] == "@"
            if not text[b - 1].isalnum():
                continue
            spelled = text[a - 5 : a] == " dot " and " at " in text[begin:a]
            if n_digits >= 7 or (n_digits >= 4 and text.count(".", begin, b) == 3) or (marked and "." in text[begin:b]) or spelled:
                out.append((i, j + 1, segment_features(text, begin, b)))
    return out


def _columns(features: list[str], kind: int) -> list[int]:
    return [zlib.crc32(f"{kind}|{f}".encode()) % DIMENSIONS for f in features]


class SemiMarkov:
    """Segments of one token of plain text score 0; entity segments score weights . features."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros(DIMENSIONS) if weights is None else weights

    def _segments(self, text: str, window) -> list[list[tuple[int, int, list[int], float]]]:
        """For each end token: (start token, kind, columns, score)."""
        ends: list[list] = [[] for _ in range(len(window) + 1)]
        for i, j, features in candidates(text, window):
            for kind in range(len(KINDS)):
                columns = _columns(features, kind)
                ends[j].append((i, kind, columns, float(self.weights[columns].sum())))
        return ends

    def decode(self, text: str, window) -> list[Span]:
        ends = self._segments(text, window)
        best, came = [0.0], [None]
        for j in range(1, len(window) + 1):
            top, how = best[j - 1], None
            for i, kind, _, score in ends[j]:
                if best[i] + score - MARGIN > top:
                    top, how = best[i] + score - MARGIN, (i, kind)
            best.append(top)
            came.append(how)
        out, j = [], len(window)
        while j > 0:
            if came[j] is None:
                j -= 1
            else:
                i, kind = came[j]
                out.append((KINDS[kind], window[i][0], window[j - 1][1]))
                j = i
        return out[::-1]

    def train_step(self, text: str, window, gold: set[Span], rate: float) -> None:
        """One gradient step on the log-likelihood, by sums over all segmentations."""
        ends = self._segments(text, window)
        n = len(window)
        ahead = [0.0] + [-math.inf] * n
        for j in range(1, n + 1):
            ahead[j] = float(np.logaddexp.reduce([ahead[j - 1]] + [ahead[i] + s for i, _, _, s in ends[j]]))
        back = [-math.inf] * n + [0.0]
        for j in range(n, 0, -1):
            back[j - 1] = float(np.logaddexp(back[j - 1], back[j]))
            for i, _, _, s in ends[j]:
                back[i] = float(np.logaddexp(back[i], back[j] + s))
        for j in range(1, n + 1):
            for i, kind, columns, s in ends[j]:
                wanted = (KINDS[kind], window[i][0], window[j - 1][1]) in gold
                step = rate * (wanted - math.exp(min(0.0, ahead[i] + s + back[j] - ahead[n])))
                if abs(step) > 1e-6:
                    np.add.at(self.weights, columns, step)


def _rewritten(text: str, spans: list[Span]) -> list[tuple[str, set[Span]]]:
    """The text around each span as it is, and without the mark its pattern needs."""
    out = []
    for kind, a, b in spans:
        left, right, body = text[max(0, a - 60) : a], text[b : b + 60], text[a:b]
        left = left[left.rfind("\n") + 1 :]
        forms = [body]
        if kind == "phone":
            forms.append(body[1:])
        if kind == "email" and "@" in body:
            forms.append(body.replace("@", " at ").replace(".", " dot "))
        out += [(left + f + right, {(kind, len(left), len(left) + len(f))}) for f in forms]
    return out


def train(texts: list[str]) -> SemiMarkov:
    examples: list[tuple[str, set[Span]]] = []
    for text in texts:
        spans = base_spans(text)
        taken = [(a, b) for _, a, b in spans]
        examples += _rewritten(text, spans[:8])
        others = [m.start() for m in _DIGIT.finditer(text) if not any(a <= m.start() < b for a, b in taken)]
        for at in others[:64:16]:
            low = max([0, at - 60, *(b for _, b in taken if b <= at)])
            high = min([len(text), at + 60, *(a for a, _ in taken if a > at)])
            examples.append((text[low:high], set()))
    examples = sorted(set((t, tuple(sorted(g))) for t, g in examples), key=lambda e: zlib.crc32(e[0].encode()))[:WINDOWS]
    model = SemiMarkov()
    for epoch in range(EPOCHS):
        for text, gold in examples:
            for window in tokens_near_anchors(text):
                model.train_step(text, window, set(gold), 0.2 / (1 + epoch))
    return model


def all_spans(text: str, model: SemiMarkov) -> tuple[list[Span], list[Span]]:
    """Base spans, and those with what the model adds."""
    base = base_spans(text)
    added = []
    for window in tokens_near_anchors(text):
        for kind, a, b in model.decode(text, window):
            if all(b <= x or a >= y for _, x, y in base):
                added.append((kind, a, b))
    return base, base + added


def training_texts(docs: DataFrame) -> list[str]:
    """At most DOCS different texts with digits or @, chosen by hash, and only the stretch around the first ones."""
    near = F.regexp_extract("text", r"(?s)(.{0,1500}[0-9@].{0,1500})", 1)
    rows = whole_text(docs).where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("text").alias("h"), "text")
    least = [r["h"] for r in rows.select("h").distinct().orderBy("h").limit(DOCS).collect()]
    texts = rows.where(F.col("h").isin(least)).select("h", near.alias("t")).groupBy("h").agg(F.min("t").alias("t"))
    return [r["t"] for r in texts.orderBy("h").collect()]


def personal_data(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row."""
    model = model or train(training_texts(docs))
    places = np.flatnonzero(model.weights)
    values = model.weights[places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(DIMENSIONS)
        weights[places] = values
        local = SemiMarkov(weights)
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans = [], []
            for scalar in batch.column(1):
                base, every = all_spans(scalar.as_py(), local)
                for n, kind in zip(counts, KINDS):
                    n.append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return whole_text(docs).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )
