"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

Tokens with a digit or an at sign are the nodes; every other word is clear and is left out. Neighbouring
nodes form the chain. A node is also linked to the next one in the document with the same text, or with
the same digits, so that a number known from one place is known in all: repeated tokens share their
potentials over any distance. Labels follow from damped loopy message passing over all links.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np

from cohortry.llm.common import DataFrame, F, T, hash_sample, per_slice, plain

# The kinds in the order of the result, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match begins at the first digit of its run, so the look back changes nothing
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

SAMPLE = 2_000   # documents the field is fitted on, at most
STATES = len(KINDS) + 1
ROUNDS = 30
SURE = 0.6       # belief from which a token is added


def _emails(text: str):
    """Leftmost matches: each is the longest local part before an at sign and the domain behind it."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    odd = [int(c) for c in reversed(digits)]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(odd)) % 10 == 0


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, passed): the patterns' matches by kind and start, and whether they pass their test."""
    out = [(0, s, e, True) for s, e in _emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))) for m in _IP.finditer(text)]
    out += [(2, m.start(), m.end(), 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d)) for m in _CARD.finditer(text)]
    if "+" in text:
        out += [(3, m.start(), m.end(), 9 <= len(_digits(m[0])) <= 15) for m in _PHONE.finditer(text)]
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    return [c[:3] for c in candidates(text) if c[3]]


_WORD = re.compile(r"\S+")
_MARK = re.compile(r"[0-9@]")
_OPEN, _CLOSE = "\"'([{<,;:", "\"')]}>,;:.!?"


@dataclass
class Nodes:
    spans: list  # (start, end) in the text
    words: list
    near: list   # whether the node follows the one before it directly
    skips: list  # (earlier, later)
    base: list   # label of the base span that covers it, or 0
    failed: list  # kinds of the failed matches that cover it


def nodes_of(text: str, found: list[tuple[int, int, int, bool]]) -> Nodes:
    spans, words, near = [], [], []
    last = -9
    for m in _WORD.finditer(text):
        w = m[0]
        if not _MARK.search(w):
            continue
        s = m.start() + len(w) - len(w.lstrip(_OPEN))
        e = m.end() - (len(w) - len(w.rstrip(_CLOSE)))
        spans.append((s, max(s, e)))
        words.append(text[s:max(s, e)])
        near.append(m.start() - last <= 2)
        last = m.end()
    seen: dict[str, int] = {}
    skips = set()
    for i, w in enumerate(words):
        d = _digits(w)
        for key in {w.lower(), d if len(d) >= 5 else w.lower()}:
            if key in seen:
                skips.add((seen[key], i))
            seen[key] = i
    label, failed = [0] * len(words), [set() for _ in words]
    starts = np.array([s for s, _ in spans])
    for kind, start, end, passed in found:
        for i in range(max(0, int(np.searchsorted(starts, start, "right")) - 1), int(np.searchsorted(starts, end))):
            if spans[i][1] > start and not passed:
                failed[i].add(kind)
            elif spans[i][1] > start and not label[i]:
                label[i] = kind + 1
    return Nodes(spans, words, near, sorted(skips), label, failed)


def _shape(w: str) -> str:
    return re.sub("[0-9]+", "9", re.sub("[A-Za-z]+", "a", w[:64]))[:16]


def features(n: Nodes) -> list[list[str]]:
    shapes = [_shape(w) for w in n.words]
    out = []
    for i, w in enumerate(n.words):
        d = len(_digits(w))
        before = shapes[i - 1] if i and n.near[i] else "-"
        after = shapes[i + 1] if i + 1 < len(shapes) and n.near[i + 1] else "-"
        out.append([f"s{shapes[i]}", f"d{min(d, 20)}", f"b{before}", f"a{after}", f"@{'@' in w}", f"x{any(c.isalpha() for c in w)}", f"f{sorted(n.failed[i])}"])
    return out


@dataclass(frozen=True)
class Field:
    names: dict
    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def index(self, rows: list[list[str]]) -> np.ndarray:
        none = len(self.names)
        return np.array([[self.names.get(f, none) for f in r] for r in rows], np.int64).reshape(len(rows), -1)


def _edges(docs: list[Nodes]) -> tuple[np.ndarray, np.ndarray, int]:
    chain, skip, at = [], [], 0
    for n in docs:
        chain += [(at + i - 1, at + i) for i in range(1, len(n.words)) if n.near[i]]
        skip += [(at + a, at + b) for a, b in n.skips]
        at += len(n.words)
    return np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2), at


def train(texts: list[str], steps: int = 200, most_features: int = 2000) -> Field | None:
    """Pseudo-likelihood fit: each label given its neighbours along the chain and the skip links. The labels
    are those of the base patterns. None without a node."""
    docs = [nodes_of(t, candidates(t)) for t in texts]
    rows = [f for n in docs for f in features(n)]
    if not rows:
        return None
    names = {f: i for i, (f, _) in enumerate(sorted(Counter(f for r in rows for f in r).items(), key=lambda x: (-x[1], x[0]))[:most_features])}
    field = Field(names, np.zeros((len(names) + 1, STATES)), np.zeros((STATES, STATES)), np.zeros((STATES, STATES)))
    x, y = field.index(rows), np.array([b for n in docs for b in n.base])
    chain, skip, n = _edges(docs)
    weights = [field.unary, field.chain, field.skip]
    sums = [np.full(w.shape, 1e-6) for w in weights]
    one = np.eye(STATES)
    for _ in range(steps):
        z = field.unary[x].sum(axis=1)
        np.add.at(z, chain[:, 1], field.chain[y[chain[:, 0]]])
        np.add.at(z, chain[:, 0], field.chain.T[y[chain[:, 1]]])
        both = np.concatenate([skip, skip[:, ::-1]])
        np.add.at(z, both[:, 0], field.skip[y[both[:, 1]]])
        p = np.exp(z - z.max(axis=1, keepdims=True))
        err = (one[y] - p / p.sum(axis=1, keepdims=True)) / n
        grads = [np.zeros_like(w) for w in weights]
        np.add.at(grads[0], x, err[:, None, :])
        np.add.at(grads[1], y[chain[:, 0]], err[chain[:, 1]])
        np.add.at(grads[1].T, y[chain[:, 1]], err[chain[:, 0]])
        np.add.at(grads[2], y[both[:, 1]], err[both[:, 0]])
        grads[2] = (grads[2] + grads[2].T) / 2
        for w, s, g in zip(weights, sums, grads):
            g -= 1e-5 * w
            s += g * g
            w += 0.3 * g / np.sqrt(s)
        field.unary[-1] = 0
    field.skip[:] = np.maximum(field.skip, np.eye(STATES)) * np.eye(STATES) + np.minimum(field.skip, 0) * (1 - np.eye(STATES))
    return field


def beliefs(field: Field, docs: list[Nodes]) -> np.ndarray:
    """Marginals of all nodes by damped loopy message passing. Labels that a base pattern gave are observed."""
    rows = [f for n in docs for f in features(n)]
    chain, skip, n = _edges(docs)
    unary = field.unary[field.index(rows)].sum(axis=1)
    known = np.array([b for d in docs for b in d.base], np.int64)
    unary[known > 0] = -20.0
    unary[known > 0, known[known > 0]] = 0.0
    edges = np.concatenate([chain, skip])
    link = np.concatenate([np.broadcast_to(field.chain, (len(chain), STATES, STATES)), np.broadcast_to(field.skip, (len(skip), STATES, STATES))])
    u, v = edges[:, 0], edges[:, 1]
    ahead, back = np.zeros((len(edges), STATES)), np.zeros((len(edges), STATES))

    def total():
        t = unary.copy()
        np.add.at(t, v, ahead)
        np.add.at(t, u, back)
        return t
    for _ in range(ROUNDS if len(edges) else 0):
        t = total()
        new_ahead = _soft((t[u] - back)[:, :, None] + link, 1)
        new_back = _soft((t[v] - ahead)[:, None, :] + link, 2)
        moved = max(np.abs(new_ahead - ahead).max(), np.abs(new_back - back).max())
        ahead, back = (ahead + new_ahead) / 2, (back + new_back) / 2
        if moved < 1e-3:
            break
    t = total()
    p = np.exp(t - t.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _soft(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    m = np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)
    return m - m.max(axis=1, keepdims=True)


def added_spans(n: Nodes, belief: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of labelled tokens that no base span touches; neighbours with one label are one span."""
    out: list[tuple[int, int, int]] = []
    before = 0
    for i, (s, e) in enumerate(n.spans):
        k = int(belief[i].argmax())
        new = k > 0 and belief[i, k] >= SURE and not n.base[i] and e > s
        if new and before == k and n.near[i]:
            out[-1] = (k - 1, out[-1][1], e)
        elif new:
            out.append((k - 1, s, e))
        before = k if new else 0
    return out


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find(texts: list[str], field: Field | None) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    out: list[tuple[list, list]] = [([], []) for _ in texts]
    marked = [i for i, t in enumerate(texts) if _MARK.search(t)]
    matches = [candidates(texts[i]) for i in marked]
    bases = [[c[:3] for c in m if c[3]] for m in matches]
    docs = [nodes_of(texts[i], m) for i, m in zip(marked, matches)]
    held = beliefs(field, docs) if field is not None and any(d.words for d in docs) else None
    at = 0
    for i, b, n in zip(marked, bases, docs):
        more = added_spans(n, held[at:at + len(n.words)], b) if held is not None else []
        at += len(n.words)
        out[i] = (b, b + more)
    return out


def fit(docs: DataFrame, most: int = SAMPLE) -> Field | None:
    """The field, from at most ``most`` documents with a digit or an at sign: those with the smallest hash."""
    marked = plain(docs, "doc_id", "text").where(F.col("text").rlike("[0-9@]"))
    return train([r["text"] for r in hash_sample(marked, ["doc_id", "text"], most).collect()])


def detect(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per row of ``docs``. Null and
    empty texts have no spans. Places count code points; ends are exclusive."""
    out = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        held = sent.value

        def work(part, texts):
            found = find(texts, held)
            counts = [[sum(k == kind for k, _, _ in b) for b, _ in found] for kind in range(len(KINDS))]
            return [part.column(0), *counts, [hashlib.sha256(_said(b).encode()).hexdigest() for b, _ in found], [_said(a) for _, a in found]]
        return work
    return per_slice(plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), "text", out, make)
