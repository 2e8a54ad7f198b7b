"""Personal data: formats that are certain, and candidates judged by boosted trees.

Generous generators propose spans: tokens with digits, runs of number groups, tokens with an at sign, the value behind
every equals sign or colon, with or without digits. Overlapping proposals are allowed. Trees boosted on the logistic
loss score each proposal by its format and its context, and what reaches the threshold of its kind is added to the certain spans it does not overlap. Labels come
from the formats themselves: a proposal that is a valid address, card or phone, or a value named as a password, token
or key, is private; a proposal that fails its format's check or is a plain short number is not; the rest is unlabelled.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import rows_out, strings, written

KINDS = ("email", "ip", "card", "phone", "handle", "number", "secret")
BASE = KINDS[:4]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match never begins within a run of digits: from there it fails as it does from the run's start
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
GROUPS = re.compile(r"\(?(?<![0-9])[0-9]++(?:[\x20().-]{1,2}[0-9]++)+")
NUMBER_TOKEN = re.compile(r"[0-9]+")
NAMED = re.compile(r"""(?i)\b(?:pass(?:word|wd)?|token|secret|api[_-]?key|key|auth)\s{0,2}[=:]\s{0,2}["']?$""")
ASSIGN = re.compile(r"""[=:](\s{0,2})["']?""")
STOP = re.compile(r"""[\s"'<>]""")
NEXT = re.compile("[&;,]")
TRAIL = re.compile(r"[.,;:!?)]+")
CUES = re.compile(r"(?i)(pass|token|secret|key|auth|mail|phone|tel|call|card|iban|ssn|account|ip\b|host)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their at signs."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            floor = domain.end()
        at = text.find("@", max(floor, at + 1))
    return out


def is_ip(match: str) -> bool:
    return all(len(part.lstrip("0")) < 4 and int(part.lstrip("0") or 0) <= 255 for part in match.split("."))


def digits_of(match: str) -> str:
    return "".join(c for c in match if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Certain spans by kind, then start; end exclusive, in characters."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if is_ip(m.group())]
        for m in CARD.finditer(text):
            digits = digits_of(m.group()) if m.end() - m.start() >= 13 else ""
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


def token_at(text: str, start: int, end: int) -> tuple[int, int]:
    """The run of characters other than white space and quotes around a place."""
    while start > 0 and not text[start - 1].isspace() and text[start - 1] not in "\"'<>":
        start -= 1
    while end < len(text) and not text[end].isspace() and text[end] not in "\"'<>":
        end += 1
    return start, end


def assigned(text: str) -> Iterator[tuple[int, int]]:
    """Values behind every equals sign and colon, to the next parameter and to the end of the token; across blanks only
    behind a name. What follows the colon of an address's scheme is no value.

    Ends of tokens, next parameters, next letters and trailing points are each found once, whatever the number of values.
    """
    end = stop = letter = 0
    trails = [m.span() for m in TRAIL.finditer(text)]
    starts = [a for a, _ in trails]

    def trimmed(at: int) -> int:
        """`at` without the points before it."""
        i = bisect.bisect_left(starts, at) - 1
        return starts[i] if i >= 0 and at <= trails[i][1] else at

    for m in ASSIGN.finditer(text):
        start = m.end()
        if text.startswith("//", start) or m.group(1) and not NAMED.search(text[max(0, start - 24) : start]):
            continue
        if end < start:
            found = STOP.search(text, start)
            end = found.start() if found else len(text)
        if stop < start:
            found = NEXT.search(text, start)
            stop = found.start() if found else len(text)
        letter = max(letter, start)
        while letter < len(text) and not text[letter].isalpha():
            letter += 1
        for last in {min(stop, end), end}:
            last = max(start, trimmed(last))
            if last - start >= 2 and letter < last:
                yield start, last


class Cover:
    """Spans by place: which of them meet a stretch of text?"""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.starts = [a for a, _ in self.spans]
        self.reach = list(itertools.accumulate((b for _, b in self.spans), max))
        self.longest = max((b - a for a, b in self.spans), default=0)

    def meets(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.starts, end)
        return i > 0 and self.reach[i - 1] > start

    def mostly(self, start: int, end: int, share: float = 0.8) -> bool:
        """Does one span cover that share of the stretch?"""
        need = share * (end - start)
        i = bisect.bisect_left(self.starts, end)
        while self.longest >= need and i > 0 and self.reach[i - 1] > start:
            i -= 1
            a, b = self.spans[i]
            if min(b, end) - max(a, start) >= need:
                return True
        return False


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping proposals (kind, start, end)."""
    found = set()
    at = text.find("@")
    while at >= 0:
        start, end = token_at(text, at, at + 1)
        if end - start > 2:
            found.add(("handle", start, end))
        at = text.find("@", end if end > at else at + 1)
    found.update(("secret", *span) for span in assigned(text))
    if DIGIT.search(text):
        for m in GROUPS.finditer(text):
            found.add(("number", *m.span()))
        done = 0
        for m in NUMBER_TOKEN.finditer(text):
            if m.start() < done:
                continue
            start, end = token_at(text, *m.span())
            done = end
            value = max(text.rfind("=", start, m.start()), text.rfind(":", start, m.start())) + 1
            value = value or start
            stop = end
            while stop > value and text[stop - 1] in ".,;:!?)":
                stop -= 1
            if any(c.isalpha() for c in text[value:stop]):
                found.add(("secret", value, stop))
            elif stop - value >= 2:
                found.add(("number", *m.span()))
    return sorted(found)


N_FEATURES = 24


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a proposal."""
    s = text[start : min(end, start + 200)]
    n = len(s)
    digits, upper = sum("0" <= c <= "9" for c in s), sum("A" <= c <= "Z" for c in s)
    lower, counts = sum("a" <= c <= "z" for c in s), Counter(s)
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))
    before, after = text[max(0, start - 24) : start], text[end : end + 24]
    groups = re.findall(r"[0-9]+", s)
    return [
        KINDS.index(kind), end - start, digits, upper, lower, n - digits - upper - lower, digits / n, entropy, len(counts) / n, changes / n, len(groups),
        max(map(len, groups), default=0), min(map(len, groups), default=0), s.count("."), s.count("-") + s.count(" "), s.count("@"), s.count("(") + s.count("+"),
        float(luhn("".join(groups))) if groups and n < 200 else 0.0, float(bool(CUES.search(before))), float(before[-1:] in "=:\"'"), float("=" in before[-3:]),
        float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after), float(all(c in "0123456789abcdefABCDEF" for c in s)),
    ]


def weak_label(text: str, kind: str, start: int, end: int, certain: Cover) -> int:
    """1 private, 0 not, -1 unknown."""
    if certain.mostly(start, end):
        return 1
    if certain.meets(start, end):
        return -1
    s = text[start:end]
    if kind == "secret":
        if NAMED.search(text[max(0, start - 16) : start]) and end - start >= 8:
            return 1
        return 0 if end - start < 8 else -1
    digits = digits_of(s)
    if kind == "number":
        return 0 if len(digits) < 7 or 13 <= len(digits) <= 19 and not luhn(digits) else -1
    return 0 if "." not in s.partition("@")[2] else -1


class Trees:
    """Regression trees of fixed depth on binned features, boosted on the logistic loss, with Platt scaling."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32):
        self.depth, self.trees = depth, []
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(N_FEATURES)]
        binned = self.binned(x)
        mean = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
        self.bias = float(np.log(mean / (1 - mean)))
        total = np.full(len(y), self.bias)
        for _ in range(rounds if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-total))
            gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
            node, tree = np.zeros(len(y), np.int64), []
            for level in range(depth):
                tree.append(self._splits(binned, node, gradient, weight, 2**level))
                feature, cut = tree[-1]
                node = 2 * node + (binned[np.arange(len(y)), feature[node]] > cut[node])
            g, h = np.bincount(node, gradient, 2**depth), np.bincount(node, weight, 2**depth)
            leaves = rate * g / (h + 1.0)
            total += leaves[node]
            self.trees.append((tree, leaves))
        self.scale, self.shift = 1.0, 0.0

    def _splits(self, binned, node, gradient, weight, nodes):
        best, feature, cut = np.full(nodes, 1e-9), np.zeros(nodes, np.int64), np.full(nodes, 255, np.int64)
        for j, edges in enumerate(self.edges):
            width = len(edges) + 1
            cell = node * width + binned[:, j]
            g = np.bincount(cell, gradient, nodes * width).reshape(nodes, width).cumsum(axis=1)
            h = np.bincount(cell, weight, nodes * width).reshape(nodes, width).cumsum(axis=1)
            total_g, total_h = g[:, -1:], h[:, -1:]
            gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
            at = gain.argmax(axis=1)
            top = gain[np.arange(nodes), at]
            better = top > best
            best[better], feature[better], cut[better] = top[better], j, at[better]
        return feature, cut

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, N_FEATURES), int)

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, out = self.binned(x), np.full(len(x), self.bias)
        for tree, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in tree:
                node = 2 * node + (binned[np.arange(len(x)), feature[node]] > cut[node])
            out += leaves[node]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling by Newton steps on rows the trees have not seen."""
        m = self.margin(x)
        for _ in range(25 if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-np.clip(self.scale * m + self.shift, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-6)
            hessian = np.array([[(w * m * m).sum() + 1e-2, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-2]])
            step = np.linalg.solve(hessian, [((y - p) * m).sum() - 1e-2 * (self.scale - 1), (y - p).sum() - 1e-2 * self.shift])
            self.scale, self.shift = self.scale + float(np.clip(step[0], -1, 1)), self.shift + float(np.clip(step[1], -1, 1))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(x) + self.shift, -30, 30)))


def thresholds(p: np.ndarray, y: np.ndarray, kinds: np.ndarray, precision: float) -> dict[str, float]:
    """The lowest probability of each kind at and above which the wanted precision holds, 0.5 at least."""
    out = {}
    for k, kind in enumerate(KINDS):
        q, t = p[kinds == k], y[kinds == k]
        order = np.argsort(-q)
        good = np.cumsum(t[order]) / np.arange(1, len(q) + 1) >= precision
        at = np.flatnonzero(good)
        out[kind] = max(0.5, float(q[order][at[-1]])) if at.size else 0.9
    return out


def training_rows(docs: DataFrame, sample_docs: int, sample_rows: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and weak labels of the proposals in about `sample_docs` texts, picked by a hash of their id; of more than
    `sample_rows` proposals, about so many, picked by a hash of their features."""
    n = docs.count()
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(9)), F.lit(1 << 30)) / float(1 << 30)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, nth = [], [], []
            for text in strings(batch, "text"):
                certain = Cover([(a, b) for _, a, b in base_spans(text)])
                for kind, a, b in candidates(text):
                    label = weak_label(text, kind, a, b, certain)
                    if label >= 0:
                        x.append(features(text, kind, a, b))
                        y.append(label)
                        nth.append(a)  # equal proposals at other places are drawn on their own
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32()), pa.array(nth, pa.int64())], names=["x", "y", "nth"])

    sample = docs.where(draw < (sample_docs / n if n else 0)).select(F.col(text_col).alias("text"))
    proposed = written(sample.mapInArrow(propose, "x array<double>, y int, nth long"), "proposals")
    rate = min(1.0, sample_rows / max(1, proposed.count()))
    chosen = proposed.where(F.pmod(F.xxhash64("x", "nth"), F.lit(1 << 30)) / float(1 << 30) < rate)
    rows = chosen.select("x", "y").toPandas()
    rows = rows.assign(key=[tuple(v) for v in rows["x"]]).sort_values(["key", "y"])  # the same order on every run
    x = np.array([list(k) for k in rows["key"]], float).reshape(-1, N_FEATURES)
    return x, rows["y"].to_numpy(float)


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray, precision: float):
        part = np.random.default_rng(1).permutation(len(y)) % 3
        self.trees = Trees(x[part > 0], y[part > 0])
        self.trees.calibrate(x[part == 0], y[part == 0])
        self.limits = thresholds(self.trees.probability(x[part == 0]), y[part == 0], x[part == 0][:, 0].astype(int), precision)


def find_spans(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(certain spans, accepted proposals that overlap none of them, nor a likelier one)."""
    certain = base_spans(text)
    taken = Cover([(a, b) for _, a, b in certain])
    open_ones = [c for c in candidates(text) if not taken.meets(c[1], c[2])]
    added: list[tuple[str, int, int]] = []
    if open_ones:
        p = np.concatenate([model.trees.probability(np.array([features(text, *c) for c in open_ones[i : i + 10_000]], float)) for i in range(0, len(open_ones), 10_000)])
        ends: list[tuple[int, int]] = []  # of the added spans, which do not meet
        for i in sorted(range(len(p)), key=lambda i: (-p[i], open_ones[i])):
            kind, a, b = open_ones[i]
            at = bisect.bisect_left(ends, (b, 0))
            if p[i] >= model.limits[kind] and (at == 0 or ends[at - 1][1] <= a):
                ends.insert(at, (a, b))
                added.append((kind, a, b))
    return certain, sorted(added, key=lambda s: (KINDS.index(s[0]), s[1]))


OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()),
                 ("redacted", pa.string())])


def find_personal_data(docs: DataFrame, sample_docs: int = 20_000, sample_rows: int = 500_000, precision: float = 0.95, with_text: bool = False, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Personal data of every whole text: counts by certain kind, a digest of the certain spans, all spans, and on request
    the text with every span replaced by its kind.

    The trees are fitted on about `sample_rows` proposals at most, of about `sample_docs` texts; thresholds reach
    `precision` on held-out proposals. A null text is an empty one and has no spans; rows with null or repeated ids are
    each searched. A text of any length is searched whole, in time that grows with its length, white space or not. Other
    columns are not read.
    """
    model = Model(*training_rows(docs, sample_docs, sample_rows, id_col, text_col), precision)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), strings(batch, "text"), strict=True):
                certain, added = find_spans(text, model)
                counts = Counter(kind for kind, _, _ in certain)
                base, every = (",".join(f"{k}:{a}:{b}" for k, a, b in spans) for spans in (certain, certain + added))
                redacted = None
                if with_text:
                    redacted = text
                    floor = len(text) + 1
                    for kind, a, b in sorted(certain + added, key=lambda s: (-s[1], s[2])):
                        redacted = redacted[:a] + f"<{kind}>" + redacted[max(a, min(b, floor)) :] if b <= floor else redacted[:a] + f"<{kind}>" + redacted[floor:]
                        floor = a
                rows.append((doc_id, *(counts[k] for k in BASE), hashlib.sha256(base.encode()).hexdigest(), every, len(added), redacted))
            if rows:
                yield rows_out(OUT, list(zip(*rows, strict=True)))

    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, redacted string"
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(search, ddl)
    return out if with_text else out.drop("redacted")
