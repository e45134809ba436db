"""Operator 5: personal data and secrets by a skip-chain conditional random field.

The nodes of a document are its tokens (between white space) that hold a digit
or an at sign, or are long runs of capitals; other tokens are O by definition
and serve as context.  Neighbouring nodes are joined by chain edges, and
distant nodes with the same letters and digits by skip edges, and those that
share only their first or last eight by edges with weights of their own, so
that a token that is clear in one place decides where it, or one like it,
stands bare.  Marginals come from
loopy message passing over each document's whole graph.  The weights are
fitted here, by pseudo-likelihood on generated text.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelume.llm.storage import kind_of

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "SECRET", "SSN", "IBAN")
#: Generated documents that the weights are fitted on.
TRAINING_DOCUMENTS = 1500
#: Rounds of messages at most; a document stops when its own messages no longer change.
ROUNDS = 200

#: What makes a token a node; the same in Java and Python.
NODE = "[0-9@]|[A-Z]{16}"
_NODE = re.compile(NODE)
_TOKEN = re.compile(r"\S+")
_EDGE = "\"'`.,;:!?<>[]{}*#$%&|"

_SHAPES: tuple[tuple[str, re.Pattern], ...] = tuple(
    (name, re.compile(p))
    for name, p in (
        ("email", r"[\w.+%-]+@[\w-]+(\.[\w-]+)+"),
        ("ip", r"((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)"),
        ("four_numbers", r"\d+\.\d+\.\d+\.\d+"),
        ("int_short", r"\d{1,3}"),
        ("int_four", r"\d{4}"),
        ("int_mid", r"\d{5,8}"),
        ("int_ten", r"\d{9,12}"),
        ("int_card", r"\d{13,19}"),
        ("int_long", r"\d{20,}"),
        ("card_groups", r"\d{4}([- ]\d{4}){2,3}"),
        ("country", r"\+\d{1,3}"),
        ("area", r"\(\d{2,5}\)"),
        ("local", r"\d{3,4}[-.]\d{3,4}"),
        ("phone_whole", r"\+?(\d{1,3}[-.])?\(?\d{3}\)?[-.]\d{3}[-.]\d{4}"),
        ("international", r"\+\d{8,15}"),
        ("decimal", r"[$€£]?\d+[.,]\d+%?"),
        ("version", r"v?\d+(\.\d+){1,2}"),
        ("date", r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"),
        ("time", r"\d{1,2}:\d{2}(:\d{2})?"),
        ("hex_long", r"[0-9a-fA-F]{16,}"),
        ("access_key", r"A[KS]IA[A-Z0-9]{12,}"),
        ("capitals_digits", r"[A-Z0-9]{16,}"),
        ("prefixed_key", r"(sk|pk|ghp|gho|xox[bp])[-_][\w-]{16,}"),
        ("capitals", r"[A-Z]{16,}"),
        ("ssn", r"\d{3}-\d{2}-\d{4}"),
        ("account", r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}"),
        ("mixed_long", r"(?=\S*\d)(?=\S*[A-Za-z])[\w/+=-]{20,}"),
        ("mixed_short", r"(?=\S*\d)(?=\S*[A-Za-z])[\w-]{2,11}"),
        ("word_number", r"[A-Za-z]+-?\d+"),
    )
)
_CUES = re.compile(r"(?i)\W*\w*(password|passwd|pwd|secret|token|api_?key|key|auth)\w*\W*")
_N_SHAPES = len(_SHAPES)
FEATURES = tuple(n for n, _ in _SHAPES) + ("assigned", "mod97", "ssn_word", "luhn", "at", "quoted", "cue_before", "equals_before", "phone_word", "card_word", "mail_word", "bias")
_NAME = re.compile(r"\W*(\w+)")
_CUE = re.compile(r"(?i)pass(word|wd)?|pwd|secret|token|api_?key|key|auth")
_SEPARATOR = re.compile("[=:]")
_SSN_WORD = re.compile(r"(?i)\W*(ssn|social|security)\W*")
_PHONE_WORD, _CARD_WORD, _MAIL_WORD = (re.compile(p) for p in (r"(?i)\W*(phone|tel|call|mobile|fax|cell)\W*", r"(?i)\W*(card|visa|credit|debit)\W*", r"(?i)\W*(e-?mail|contact|write)\W*"))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _assigned(core: str) -> bool:
    """A name that speaks of a secret, = or :, and six characters or more; in time linear in the length."""
    m = _SEPARATOR.search(core, len(core) - len(core.lstrip("=:")))
    if not m or len(core) - m.end() < 6:
        return False
    name = _NAME.fullmatch(core, 0, m.start())
    return bool(name and _CUE.search(name.group(1)))


def _mod97(core: str) -> bool:
    """Check digits of an international account number."""
    turned = core[4:] + core[:4]
    return 15 <= len(core) <= 34 and core.isascii() and core.isalnum() and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


class Node(NamedTuple):
    start: int
    end: int
    features: list[int]
    key: str
    after: bool  # the node before is the token before


def nodes(text: str) -> list[Node]:
    """Nodes of a text in order; offsets are characters, without quotes and punctuation around."""
    out: list[Node] = []
    pos = 0
    last_end = -1
    while m := _NODE.search(text, pos):
        a = m.start()
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        t = _TOKEN.match(text, a)
        raw, pos = t.group(), t.end()
        core = raw.strip(_EDGE)
        start = a + (raw.find(core) if core else 0)
        end = start + len(core) if core else pos
        core = core or raw
        f = [i for i, (_, p) in enumerate(_SHAPES) if p.fullmatch(core)]
        digits = re.sub(r"\D", "", core) if len(core) < 40 else ""
        before = text[max(0, a - 40) : a].split()
        extra = (
            _assigned(core),
            _mod97(core),
            any(_SSN_WORD.fullmatch(w) for w in before[-2:]),
            13 <= len(digits) <= 19 and _luhn(digits),
            "@" in core[1:-1],
            raw[:1] in "\"'`",
            any(_CUES.fullmatch(w) for w in before[-2:]),
            bool(before) and before[-1][-1] in "=:",
            any(_PHONE_WORD.fullmatch(w) for w in before[-2:]),
            any(_CARD_WORD.fullmatch(w) for w in before[-2:]),
            any(_MAIL_WORD.fullmatch(w) for w in before[-2:]),
            True,
        )
        f += [_N_SHAPES + i for i, x in enumerate(extra) if x]
        key = re.sub(r"[\W_]+", "", core.rsplit("=", 1)[-1]).lower()
        out.append(Node(start, end, f, key, last_end >= 0 and not text[last_end:a].strip()))
        last_end = pos
    return out


class Graph(NamedTuple):
    """Features (n x FEATURES), chain, skip and similar edges (m x 2) over the nodes of many documents, and each node's document."""

    x: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    similar: np.ndarray
    doc: np.ndarray


#: Characters and digits that a key needs to make skip edges; shorter ones (years, prices, parts of numbers) repeat by chance.
MIN_KEY = 6
#: First or last characters of the keys of similar tokens, which are longer by half at least.
SIMILAR = 8


def graph(documents: list[list[Node]], min_key: int = MIN_KEY) -> Graph:
    """The graph of each document: a repeated key is joined with its last occurrence, a similar one with the last of the same beginning or else end."""
    n = sum(map(len, documents))
    x = np.zeros((n, len(FEATURES)), np.float32)
    chain, skip, similar, i = [], [], [], 0
    for doc in documents:
        seen: dict[str, int] = {}
        near: dict[tuple[int, str], int] = {}
        for k, node in enumerate(doc):
            x[i, node.features] = 1
            if k and node.after:
                chain.append((i - 1, i))
            if len(node.key) >= min_key:
                j = seen.get(node.key)
                ends = [(0, node.key[:SIMILAR]), (1, node.key[-SIMILAR:])] if 2 * len(node.key) >= 3 * SIMILAR else []
                if j is not None:
                    skip.append((j, i))
                else:
                    j = next((near[e] for e in ends if e in near), None)
                    if j is not None:
                        similar.append((j, i))
                seen[node.key] = i
                for e in ends:
                    near[e] = i
            i += 1
    edges = [np.array(e, np.int64).reshape(-1, 2) for e in (chain, skip, similar)]
    return Graph(x, *edges, np.repeat(np.arange(len(documents)), [len(d) for d in documents]))


class Weights(NamedTuple):
    """Log potentials: features x labels, and by kind of edge, label before x label after."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    similar: np.ndarray


def _logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(g: Graph, w: Weights, rounds: int = ROUNDS, damping: float = 0.3, tolerance: float = 1e-4) -> np.ndarray:
    """Label probabilities of every node by loopy sum-product message passing.

    Each document stops by itself, when none of its messages changes by
    ``tolerance`` any more, so its probabilities don't depend on what else is
    in the batch.  One that doesn't settle within ``rounds`` is read as it
    stands after the last of them.
    """
    theta = g.x.astype(np.float64) @ w.node
    k = w.node.shape[1]
    edges = np.concatenate([g.chain, g.skip, g.similar])
    if len(edges):
        kind = np.repeat(np.arange(3), [len(g.chain), len(g.skip), len(g.similar)])
        pots = np.stack([w.chain, w.skip, w.similar, w.chain.T, w.skip.T, w.similar.T])
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        kind = np.concatenate([kind, kind + 3])
        back = np.concatenate([np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))])
        msg = np.full((len(src), k), -np.log(k))
        of = g.doc[src]
        live = np.arange(len(src))
        for _ in range(rounds):
            belief = theta.copy()
            np.add.at(belief, dst[live], msg[live])
            new = _logsumexp((belief[src[live]] - msg[back[live]])[:, :, None] + pots[kind[live]], axis=1)
            new -= _logsumexp(new, axis=1)[:, None]
            change = np.abs(new - msg[live]).max(axis=1)
            msg[live] = damping * msg[live] + (1 - damping) * new
            moving = np.zeros(g.doc[-1] + 1, bool)
            moving[of[live[change >= tolerance]]] = True
            live = live[moving[of[live]]]
            if not len(live):
                break
        np.add.at(theta, dst, msg)
    return np.exp(theta - _logsumexp(theta, axis=1)[:, None]) if len(theta) else np.zeros((0, k))


# --- fitting --------------------------------------------------------------


def generated(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts of invented words with private data, its bare repeats, and harmless numbers; spans (start, end, label)."""
    rng = random.Random(seed)

    def letters(lo: int, hi: int) -> str:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(lo, hi)))

    def of(chars: str, lo: int, hi: int) -> str:
        return "".join(rng.choice(chars) for _ in range(rng.randint(lo, hi)))

    def d(lo: int, hi: int | None = None) -> str:
        return of("0123456789", lo, hi or lo)

    hexes, caps = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

    def card() -> str:
        body = rng.choice("3456") + d(14)
        return body + next(c for c in "0123456789" if _luhn(body + c)) if rng.random() < 0.6 else body + d(1)

    def account() -> str:
        land, rest = of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2, 2), of("0123456789", 11, 23)
        return next(x for i in range(98) if _mod97(x := f"{land}{i + 2:02d}{rest}"))

    def like(value: str) -> str:
        """``value`` with some of its last characters, or its first, drawn anew."""
        n, at_end = rng.randint(1, 3), rng.random() < 0.7
        drawn = (rng.choice("0123456789" if c.isdigit() else "abcdef" if c.islower() else "GHJKLM" if c.isupper() else c) for c in (value[-n:] if at_end else value[:n]))
        part = "".join(drawn)
        return value[:-n] + part if at_end else part + value[n:]

    def private() -> tuple[str, str, str]:
        kind = rng.choice(("EMAIL", "PHONE", "IP", "CARD", "SECRET", "SECRET", "EMAIL", "PHONE", "IP", "CARD", "SECRET", "SECRET", "SSN", "IBAN"))
        if kind == "SSN":
            return kind, rng.choice(("", "ssn ", "SSN: ")), f"{d(3)}-{d(2)}-{d(4)}"
        if kind == "IBAN":
            return kind, rng.choice(("", "iban ", "account ")), account()
        if kind == "EMAIL":
            return kind, "", f"{letters(2, 8)}{rng.choice(['', '.', '_'])}{rng.choice([letters(1, 6), d(1, 3)])}@{letters(3, 8)}{rng.choice(['', d(1)])}.{rng.choice(['com', 'org', 'co.uk', 'example.com'])}"
        if kind == "PHONE":
            form = rng.choice(("+{c} ({a}) {b}-{e}", "({a}) {b}-{e}", "{a}-{b}-{e}", "+{c}{a}{b}{e}", "+{c}-{a}-{b}-{e}"))
            return kind, rng.choice(("", "", "call ", "phone: ")), form.format(c=d(1, 2), a=d(3), b=d(3), e=d(4))
        if kind == "IP":
            return kind, "", ".".join(str(rng.randint(1, 255)) for _ in range(4))
        if kind == "CARD":
            c = card()
            return kind, rng.choice(("", "", "card ")), rng.choice((c, c, "-".join(c[i : i + 4] for i in range(0, 16, 4))))
        value = rng.choice((of(hexes, 16, 48), of(hexes, 16, 48), of(hexes, 8, 15), of(caps + caps.lower(), 20, 40) + d(1)))
        form = rng.choice(("key", "assign", "assign", "quoted", "quoted", "prefix") if len(value) > 15 else ("assign", "quoted"))
        if form == "key":
            return kind, "", "AKIA" + of(caps, 16, 16)
        if form == "prefix":
            return kind, "", rng.choice(("sk-", "ghp_", "pk_")) + value
        name = rng.choice(("password", "token", "secret", "api_key", "auth_token", "PASSWORD"))
        if form == "assign":
            return kind, "", f"{name}{rng.choice('=:')}{value}"
        return kind, f"{name} {rng.choice('=:')} ", f'"{value}"'

    def harmless() -> str:
        return rng.choice(
            (d(1, 3), str(rng.randint(1900, 2030)), d(5, 8), f"${d(1, 3)}.{d(2)}", f"{d(1, 2)}.{d(1, 3)}", f"{d(1)}.{d(1)}.{d(1, 2)}", f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}", f"{of(caps, 2, 3)}-{d(3, 5)}", f"{letters(2, 6)}{d(1, 2)}", f"{d(1)}rd", f"{d(2)}%", f"{d(9, 11)}", f"@{letters(3, 9)}", f"{d(2)}/{d(2)}", f"{letters(3,7)}@", f"{300 + rng.randint(0, 600)}.{d(3)}.{d(3)}.{d(3)}", of(hexes, 8, 15), of(caps[:26], 16, 24) + rng.choice(("", "!!")))
        )

    out = []
    for _ in range(n):
        text, spans, kept, plain = "", [], [], []
        for _ in range(rng.randint(10, 40)):
            r = rng.random()
            if r < 0.12:
                label, before, value = private()
                text += before
                a = len(text)
                spans.append((a, a + len(value), label))
                text += value
                kept.append((label, value.split("=")[-1].split(":")[-1].strip('"') if label == "SECRET" else value))
            elif r < 0.18 and kept:
                label, value = rng.choice(kept)
                spans.append((len(text), len(text) + len(value), label))
                text += value
            elif r < 0.20 and kept and (alike := [x for x in kept if x[0] in ("SECRET", "EMAIL", "IBAN") and 2 * sum(map(str.isalnum, x[1])) >= 3 * SIMILAR]):
                label, value = rng.choice(alike)
                value = like(value)
                spans.append((len(text), len(text) + len(value), label))
                text += value
            elif r < 0.23 and plain:
                text += rng.choice(plain) if rng.random() < 0.6 else like(rng.choice(plain))
            elif r < 0.36:
                plain.append(harmless())
                text += plain[-1]
            else:
                text += letters(1, 9)
            text += rng.choice((" ", " ", " ", " ", ", ", ". ", "\n"))
        out.append((text, spans))
    return out


def labelled(sample: list[tuple[str, list[tuple[int, int, str]]]]) -> tuple[list[list[Node]], np.ndarray]:
    """Nodes of each text, and the labels of all."""
    docs, y = [], []
    for text, spans in sample:
        ns = nodes(text)
        docs.append(ns)
        for n in ns:
            y.append(next((LABELS.index(label) for a, b, label in spans if n.start < b and n.end > a), 0))
    return docs, np.array(y, np.int64)


@functools.lru_cache(maxsize=4)
def fitted(n: int = TRAINING_DOCUMENTS, seed: int = 5, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> Weights:
    """Weights of the largest pseudo-likelihood: each node given its neighbours' labels."""
    docs, y = labelled(generated(n, seed))
    g, k = graph(docs), len(LABELS)
    hot = np.eye(k)[y]
    kinds = (g.chain, g.skip, g.similar)
    w = [np.zeros((len(FEATURES), k))] + [np.zeros((k, k)) for _ in kinds]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for t in range(1, steps + 1):
        score = g.x @ w[0]
        for e, p in zip(kinds, w[1:]):
            np.add.at(score, e[:, 1], p[y[e[:, 0]]])
            np.add.at(score, e[:, 0], p[:, y[e[:, 1]]].T)
        miss = np.exp(score - _logsumexp(score, axis=1)[:, None]) - hot
        grad = [g.x.T @ miss / len(y)]
        for e in kinds:
            p = np.zeros((k, k))
            np.add.at(p, y[e[:, 0]], miss[e[:, 1]])
            np.add.at(p.T, y[e[:, 1]], miss[e[:, 0]])
            grad.append(p / len(y))
        for i in range(len(w)):
            d = grad[i] + decay * w[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.999 * v[i] + 0.001 * d * d
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Weights(*w)


# --- application ----------------------------------------------------------


def entities(texts: list[str | None], w: Weights) -> Iterator[tuple[int, str, int, int, float]]:
    """(text number, label, start, end, least probability); neighbouring phone parts make one entity."""
    docs = [nodes(t) if t else [] for t in texts]
    p = marginals(graph(docs), w)
    label, prob = p.argmax(axis=1), p.max(axis=1)
    i = 0
    for d, doc in enumerate(docs):
        open_: list | None = None
        for node in doc:
            name = LABELS[label[i]]
            if open_ and name == "PHONE" and open_[1] == "PHONE" and node.after:
                open_[3], open_[4] = node.end, min(open_[4], float(prob[i]))
            else:
                if open_:
                    yield tuple(open_)
                open_ = [d, name, node.start, node.end, float(prob[i])] if name != "O" else None
            i += 1
        if open_:
            yield tuple(open_)


def private_data(docs: DataFrame) -> DataFrame:
    """(doc_id, label, start, end, value, probability) of each entity in every row of ``docs``.

    The kinds are those of LABELS; names and postal addresses, which need
    gazetteers, are none of them, and an IBAN is found where it is written in
    one piece.  Offsets count characters of the whole text, the end exclusive.
    Rows without entities (null and empty texts too) give none; repeated rows
    give theirs each, and of labels of one probability the first in LABELS
    counts.  Any text length is read as one graph, in time that grows with its
    length; a row's result doesn't depend on other rows.  Skip edges need keys
    of MIN_KEY letters and digits.
    """
    w = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = batch.column("text").to_pylist()
                rows = [(d, label, a, b, texts[d][a:b], round(p, 4)) for d, label, a, b, p in entities(texts, w)]
                of, *rest = (pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64())))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(of), *rest],
                    names=["doc_id", "label", "start", "end", "value", "probability"],
                )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").rlike(NODE))
    return rows.mapInArrow(run, f"doc_id {kind_of(docs, 'doc_id')}, label string, start bigint, end bigint, value string, probability double")
