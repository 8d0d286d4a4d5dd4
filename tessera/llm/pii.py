"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The random field labels the other number-like and address-like tokens of a
document: neighbours in the text share chain potentials, and repeated or similar tokens, however far apart,
share skip potentials, so what is an entity at one place is one at the others. Its weights are learned from
the base spans of a bounded sample of documents, and from other spellings of the same tokens, whose label is known and which the
patterns do not find: what they have to go by is the tie. Inference is loopy belief propagation on the same graph.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch
from tessera.llm.words import chunks

KINDS = ("email", "ip", "card", "phone")
O = len(KINDS)  # the label of everything else  # noqa: E741
_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run between separators that holds a digit or an @; tried only where a run begins, so each character is read once.
_TOKEN = re.compile(r"(?<![^\s,;:!?\"'<>|])[^\s,;:!?\"'<>|0-9@]*+[0-9@][^\s,;:!?\"'<>|]*+")
_PLAIN = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """One scan: each @ with a domain takes the run of local characters before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at) if lo < at else None
        if m:
            out.append((lo, m.end()))
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern matches that pass their test, by kind and start."""
    if not _PLAIN.search(text):
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


@dataclass
class Nodes:
    """The tokens of a document that may be part of an entity."""

    span: list[tuple[int, int]]
    seen: np.ndarray  # label by the base spans, O where there is none
    feature: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    whole: dict[int, str] = field(default_factory=dict)  # base span that ends with a token


def _shape(token: str) -> list[int]:
    """Numbers of the token's features; all are below N_FEATURES."""
    digits = [c for c in token if "0" <= c <= "9"]
    n, size = len(digits), len(token)
    flags = ("@" in token, "." in token, "-" in token, "+" in token, "(" in token or ")" in token, any(c.isalpha() for c in token))
    out = [0, 1 + min(n, 20), 22 + sum(f << i for i, f in enumerate(flags)), 86 + min(token.count("."), 4), 91 + min(size // 4, 6)]
    if n == size and n >= 13:
        out.append(98 + luhn(token))
    return out


N_FEATURES = 100


def _keys(token: str) -> list[str]:
    """What similar tokens share: the letters in lower case and the digits, without marks; the last six of longer numbers; of an address also what stands before the @."""
    plain = "".join(c for c in token.lower() if c.isalnum() or c == "@")
    if plain.isdigit():
        plain = plain[-6:]
    found = [plain, plain.split("@")[0]] if "@" in plain else [plain]
    return [k for k in found if len(k) >= 5]


def spellings(token: str) -> list[list[str]]:
    """Other ways to write a token, each as a row of tokens, whose last one has a key of the token's; none for short numbers and plain words."""
    digits = "".join(c for c in token if "0" <= c <= "9")
    if "@" in token:
        local = token.split("@")[0]
        return [[token.upper()], *([[local]] if any("0" <= c <= "9" for c in local) and _keys(local) else [])]
    if len(digits) < 7 or any(c.isalpha() for c in token):
        return []
    if len(digits) >= 13:
        return [[".".join(digits[i : i + 4] for i in range(0, len(digits), 4))], [digits[:-6], digits[-6:]]]
    short = digits[-10:]
    return [[digits], [short], [f"{digits[-7:-4]}-{digits[-4:]}"], [f"{short[:-7]}-{short[-7:-4]}-{short[-4:]}"[-12:].lstrip("-")], [digits[:-6], digits[-6:]], [digits[:2], digits[2:-6] or "0", digits[-6:]]]


def _ties(like: list[int], seen: np.ndarray) -> list[tuple[int, int]]:
    """Ties each token to one of its like: the first of the most frequent base label, or the first where none has one.

    So what is known at one place is at most two ties from all others, however many lie between, with n - 1 edges.
    """
    given = [int(seen[i]) for i in like if seen[i] != O]
    most = max(set(given), key=lambda k: (given.count(k), -k)) if given else O
    hub = next(i for i in like if seen[i] == most)
    return [(hub, i) for i in like if i != hub]


def _skips(tokens: list[str], seen: np.ndarray, whole: dict[int, str]) -> list[tuple[int, int]]:
    """Ties between tokens that share a key; ``whole`` has the base span that ends with a token, whose keys are the token's, too."""
    by: dict[str, list[int]] = defaultdict(list)
    for i, t in enumerate(tokens):
        for k in dict.fromkeys([*_keys(t), *(_keys(whole[i]) if i in whole else [])]):
            by[k].append(i)
    return list(dict.fromkeys(e for like in by.values() for e in _ties(like, seen)))


def nodes(text: str, base: list[tuple[int, int, int]]) -> Nodes:
    """The tokens of a text with their base labels, neighbours at most two characters apart, and ties between repeats."""
    span = [m.span() for m in _TOKEN.finditer(text)]
    cover = sorted((a, b, k) for k, a, b in base)
    seen, whole = np.full(len(span), O), {}
    j = 0
    for i, (a, b) in enumerate(span):
        while j < len(cover) and cover[j][1] <= a:
            j += 1
        if j < len(cover) and cover[j][0] < b:
            seen[i] = cover[j][2]
            if b >= cover[j][1]:
                whole[i] = text[cover[j][0] : cover[j][1]]
    chain = [(i, i + 1) for i in range(len(span) - 1) if span[i + 1][0] - span[i][1] <= 2]
    tokens = [text[a:b] for a, b in span]
    return Nodes(span, seen, [_shape(t) for t in tokens], chain, _skips(tokens, seen, whole), whole)


def lesson(text: str, base: list[tuple[int, int, int]], lo: int, hi: int, seed: int) -> Nodes:
    """Tokens lo to hi of a text with their labels, and one other spelling of each base span and each other token that has some, with its label.

    The spellings stand apart from the text and from each other; they are tied as in ``nodes``, where only base labels are given.
    """
    d = nodes(text, base)
    seen, tokens = d.seen[lo:hi], [text[a:b] for a, b in d.span[lo:hi]]
    chain = [(x - lo, y - lo) for x, y in d.chain if lo <= x and y < hi]
    label, whole = seen.tolist(), {i - lo: t for i, t in d.whole.items() if lo <= i < hi}
    for i in range(len(seen)):
        if other := spellings(whole.get(i, tokens[i]) if seen[i] == O or i in whole else ""):
            row = other[(seed + i) % len(other)]
            chain += [(len(tokens) + j, len(tokens) + j + 1) for j in range(len(row) - 1)]
            tokens += row
            label += [label[i]] * len(row)
    given = np.concatenate([seen, np.full(len(tokens) - len(seen), O)])
    return Nodes([(0, 0)] * len(tokens), np.array(label, np.int64), [_shape(t) for t in tokens], chain, _skips(tokens, given, whole))


@dataclass
class SkipChain:
    unary: np.ndarray  # [features, labels]
    chain: np.ndarray  # [labels, labels]
    skip: np.ndarray

    @classmethod
    def fit(cls, docs: list[Nodes], *, steps: int = 600, rate: float = 0.5, l2: float = 1e-4, keep: float = 0.9) -> SkipChain:
        """Pseudo-likelihood: each token's label given those of its neighbours, by gradient descent with momentum."""
        k = O + 1
        y, feats, chain, skip = [], [], [], []
        for d in docs:
            off = len(y)
            y += d.seen.tolist()
            feats += d.feature
            chain += [(a + off, b + off) for a, b in d.chain]
            skip += [(a + off, b + off) for a, b in d.skip]
        y = np.array(y, np.int64)
        if not len(y):
            unary = np.zeros((N_FEATURES, k))
            unary[0, O] = 4.0
            return cls(unary, np.eye(k) * 0.5, np.eye(k) * 2.0)
        x = np.zeros((len(y), N_FEATURES))
        for i, f in enumerate(feats):
            x[i, f] = 1
        near = []
        for edges in (chain, skip):
            e = np.array(edges, np.int64).reshape(-1, 2)
            c = np.zeros((len(y), k))
            np.add.at(c, (e[:, 0], y[e[:, 1]]), 1)
            np.add.at(c, (e[:, 1], y[e[:, 0]]), 1)
            near.append(c)
        u, ws = np.zeros((N_FEATURES, k)), [np.zeros((k, k)), np.zeros((k, k))]
        target, du, dws = np.eye(k)[y], np.zeros_like(u), [np.zeros((k, k)), np.zeros((k, k))]
        for _ in range(steps):
            z = x @ u + sum(c @ w for c, w in zip(near, ws))
            p = np.exp(z - z.max(axis=1, keepdims=True))
            err = (p / p.sum(axis=1, keepdims=True) - target) / len(y)
            du[:] = keep * du - rate * (x.T @ err + l2 * u)
            u += du
            for c, w, dw in zip(near, ws, dws):
                g = c.T @ err
                dw[:] = keep * dw - rate * ((g + g.T) / 2 + l2 * w)
                w += dw
        return cls(u, *ws)

    def infer(self, d: Nodes, rounds: int = 200) -> np.ndarray:
        """Marginals [tokens, labels] by damped sum-product messages; base labels are given.

        Stops when no message changes; ``rounds`` ends those that swing.
        """
        k, n = O + 1, len(d.span)
        local = np.stack([self.unary[f].sum(axis=0) for f in d.feature]) if n else np.zeros((0, k))
        given = d.seen != O
        local[given] = -50.0
        local[given, d.seen[given]] = 0.0
        edges = np.array(d.chain + d.skip, np.int64).reshape(-1, 2)
        if len(edges):
            weight = np.concatenate([np.repeat(self.chain[None], len(d.chain), 0), np.repeat(self.skip[None], len(d.skip), 0)])
            src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            weight = np.concatenate([weight, weight.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            message = np.zeros((len(src), k))
            for _ in range(rounds):
                belief = local.copy()
                np.add.at(belief, dst, message)
                z = (belief[src] - message[back])[:, :, None] + weight
                top = z.max(axis=1)
                new = top + np.log(np.exp(z - top[:, None, :]).sum(axis=1))
                new -= new.max(axis=1, keepdims=True)
                if np.abs(new - message).max() < 1e-4:
                    break
                message = 0.3 * message + 0.7 * new
            np.add.at(local, dst, message)
        p = np.exp(local - local.max(axis=1, keepdims=True)) if n else local
        return p / p.sum(axis=1, keepdims=True) if n else p

    def spans(self, text: str, base: list[tuple[int, int, int]], sure: float = 0.9) -> list[tuple[int, int, int]]:
        """Base spans and those the field adds: runs of neighbouring tokens of one kind, at least as likely as ``sure``."""
        if not _PLAIN.search(text):
            return list(base)
        d = nodes(text, base)
        if (d.seen != O).all():
            return list(base)
        p = self.infer(d)
        label = np.where(p.max(axis=1) >= sure, p.argmax(axis=1), O)
        label[d.seen != O] = O  # they have their base span
        names = {k for kind, a, b in base if kind == 0 for k in _keys(text[a:b])}
        linked, added, i = set(d.chain), [], 0
        while i < len(label):
            j = i
            while j + 1 < len(label) and label[j + 1] == label[i] and (j, j + 1) in linked:
                j += 1
            if label[i] != O:
                a, b = d.span[i][0], d.span[j][1]
                while b > a and text[b - 1] in ".-":
                    b -= 1
                if _plausible(int(label[i]), text[a:b], names):
                    added.append((int(label[i]), a, b))
            i = j + 1
        return sorted({*base, *added})


def _plausible(kind: int, text: str, names: set[str]) -> bool:
    """An added span has at least the body of its kind; ``names`` are the keys of the addresses that the patterns found."""
    digits = sum("0" <= c <= "9" for c in text)
    if kind == 0:
        return "@" in text[1:-1] or any(k in names for k in _keys(text))
    if kind == 1:
        return text.count(".") == 3 and all(x.isdigit() and len(x) <= 3 for x in text.split("."))
    return 13 <= digits <= 19 if kind == 2 else 7 <= digits <= 15


def listed(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end of the spans by kind and start, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _limit(sizes: list[int], tokens: int) -> int:
    """The most tokens a document may give so that all of them give no more than ``tokens``."""
    lo, hi = 0, max(sizes, default=0)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if sum(min(n, mid) for n in sizes) <= tokens else (lo, mid - 1)
    return lo


def train(docs: DataFrame, *, sample: int = 4000, tokens: int = 50_000) -> SkipChain:
    """Learns from at most ``sample`` documents that hold a digit or an @ sign, the same at every run.

    All of them give at most ``tokens`` tokens together. Where they hold more, the long ones give a stretch, at a place by
    their hash, of as many tokens as leaves room for every other; it is cut on the executors, which first count. Other spellings
    come on top, at most three tokens for each.
    """
    scratch = Scratch(docs.sparkSession, "pii")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(1 for _ in _TOKEN.finditer(t)) for t in b.column(1).to_pylist()], pa.int64())], names=["n"])

    def gather(limit: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    n = sum(1 for _ in _TOKEN.finditer(t))
                    lo = h % (n - limit + 1) if n > limit else 0
                    d = lesson(t, base_spans(t), lo, lo + limit, h)
                    out.append((d.seen.tolist(), d.feature, [list(e) for e in d.chain], [list(e) for e in d.skip]))
                kinds = (pa.list_(pa.int64()), *[pa.list_(pa.list_(pa.int64()))] * 3)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], names=["h", "seen", "feature", "chain", "skip"])

        return run

    text = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    some = text.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(min(sample, tokens))
    text = text.withColumn("h", F.xxhash64("text")).join(F.broadcast(some), "h").groupBy("h").agg(F.min("text").alias("text"))
    text = scratch.save(text)
    limit = _limit([r["n"] for r in text.mapInArrow(count, "n long").collect()], tokens)
    rows = text.mapInArrow(gather(limit), "h long, seen array<long>, feature array<array<long>>, chain array<array<long>>, skip array<array<long>>").collect()
    scratch.drop(text)
    rows = sorted(rows, key=lambda r: r["h"])
    return SkipChain.fit([Nodes([(0, 0)] * len(r["seen"]), np.array(r["seen"], np.int64), [list(f) for f in r["feature"]], [tuple(e) for e in r["chain"]], [tuple(e) for e in r["skip"]]) for r in rows])


def find(docs: DataFrame, model: SkipChain) -> DataFrame:
    """doc_id, base array of (kind, start, end), spans array of (kind, start, end) of every row.

    Offsets are code points, ends exclusive. Null and empty texts have no spans. Rows are independent:
    repeated and null doc_ids keep theirs; other columns are ignored; nothing is shuffled.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base = [base_spans(t or "") for t in b.column(1).to_pylist()]
            every = [model.spans(t or "", x) for t, x in zip(b.column(1).to_pylist(), base)]
            cols = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in row] for row in rows], kind) for rows in (base, every)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "base", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    span = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(run, f"doc_id long, base {span}, spans {span}")


def redact(docs: DataFrame, model: SkipChain) -> DataFrame:
    """All rows and columns, with each span of personal data in ``text`` replaced by its kind in angle brackets."""
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if not text or not _PLAIN.search(text):
            return text
        out, done = [], 0
        for a, b, k in sorted((a, b, k) for k, a, b in model.spans(text, base_spans(text))):
            if b <= done:
                continue
            out += [text[done : max(a, done)], f"<{KINDS[k]}>" if a >= done else ""]
            done = b
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in chunks(b.column(at).to_pylist()):
                part = b.slice(lo, hi - lo)
                texts = pa.array([clean(t) for t in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([texts if i == at else part.column(i) for i in range(part.num_columns)], schema=part.schema.set(at, pa.field("text", pa.string())))

    return docs.mapInArrow(run, docs.schema)
