"""Personal data: patterns, and a skip-chain conditional random field that adds to them.

Patterns give base spans of four kinds. The field's nodes are the tokens of a
text that have a digit, '@' or '+'. Neighbouring tokens share chain potentials.
Tokens that are repeated, and tokens of one form, share skip potentials however
distant they are: all of one key are joined to a hub that stands for the label of
the entity, so that edges grow with the tokens and a mention is two steps from any
other. Loopy message passing over all texts of a batch, until messages settle,
makes labels consistent within each document. Spans of confident tokens that no
base span covers are added; base spans stay.

The field is trained piecewise on a bounded sample of documents: token weights
by a softmax over their shapes, chain and skip potentials (whole tables) by how
much more often labels meet than by chance. Labels come from the base spans;
tokens under long matches that fail their check have none.

Defined cases: a null text counts as empty; repeated rows stay; without any
candidate token in the sample nothing is added; an empty table gives an empty
result. Extra columns are carried along.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigrain.llm.samples import bounded, fitted
from evigrain.runtime import tuned

KINDS = ("email", "ip", "card", "phone")
#: Documents that training uses at most.
TRAINING_ROWS = 2000
#: Message passing ends when no message moves by more than SETTLED, or after so many rounds.
ROUNDS, DAMPING, SETTLED = 60, 0.5, 1e-8
SURE = 0.9
#: Bounds of learned log potentials: chain edges, hubs of repeated tokens, hubs of tokens of one form.
CHAIN, SAME, ALIKE = 0, 1, 2
BOUNDS = (1.0, 3.0, 1.0)
#: Meetings that are counted before any that are seen, and which share of them is of one label: repeated tokens are taken to agree until texts show otherwise.
PRIOR, AGREE = 20.0, (0.0, 0.9, 0.0)

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\s,;\"'<>{}\[\]|\x80-\U0010ffff]+|[^\s\x00-\x7f]+")
_LETTERS = re.compile(r"[A-Za-z]+")
_DIGIT = re.compile(r"[0-9]")
_TELLING = re.compile(r"[0-9@+]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_EDGES = ".,;:!?%&*$#\"'<>[]{}|="
_HINTS = (
    frozenset(("mail", "email", "e-mail", "contact", "write")),
    frozenset(("ip", "host", "server", "address", "from")),
    frozenset(("card", "visa", "mastercard", "pay", "credit", "debit")),
    frozenset(("tel", "phone", "call", "fax", "mobile", "telephone", "sms")),
    frozenset(("version", "v", "license", "page", "chapter", "no", "section")),
)

_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

Span = tuple[int, int, int]  # start, kind, end: sorts as spans are listed


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        after = at + 1
        domain = _DOMAIN.match(text, after)
        if domain:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, domain.end()))
                done = after = domain.end()
        at = text.find("@", after)
    return out


def _addresses(text: str) -> list[Span]:
    out = []
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        if len(parts) < 4:
            continue
        at = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                out.append((at, 1, end))
            at = end + 1
    return out


def base_spans(text: str) -> list[Span]:
    """Spans that the patterns find, leftmost and without overlap in each kind; what fails its check is dropped."""
    if not _TELLING.search(text):
        return []
    out = _emails(text) + _addresses(text)
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group()) if m.end() - m.start() < 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def failed_spans(text: str) -> list[tuple[int, int]]:
    """Long matches that fail their check: what they cover may be anything."""
    if not _TELLING.search(text):
        return []
    found = [(m, 12, 19) for m in _CARD.finditer(text)] + [(m, 9, 15) for m in _PHONE.finditer(text)]
    return [m.span() for m, low, high in found if (n := len(_NOT_DIGIT.sub("", m.group()))) > high or n >= low == 12 and not luhn(_NOT_DIGIT.sub("", m.group()))]


class Nodes(NamedTuple):
    """Candidate tokens of one text: core start and end, number in the token sequence, keys of repetition and of form, shape features."""

    spans: list[tuple[int, int]]
    places: list[int]
    keys: list[tuple[str, str]]
    shapes: list[list[float]]


def _near(n: int, bounds: tuple[int, ...]) -> list[float]:
    return [float(low <= n < high) for low, high in zip(bounds, (*bounds[1:], 1 << 60), strict=True)]


def _shape(core: str, digits: str, before: str, after: str) -> list[float]:
    at, dots = core.rfind("@"), core.count(".")
    parts = core.split(".") if dots == 3 else []
    quad = len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts)
    word = before.strip(_EDGES).lower()
    return [
        1.0, float(at > 0), float(at > 0 and "." in core[at:]), float(quad), float(core.isdecimal()), float(core[:1] == "+"), float("(" in core), float("-" in core), float(any(c.isalpha() for c in core)),
        float(12 <= len(digits) <= 19 and luhn(digits)), float(bool(before and before[0] == "+")), float(before[:1] == "("), float(after[:1] == "("), float(bool(re.search("[0-9]", before))), float(bool(re.search("[0-9]", after))),
        *_near(len(digits), (0, 1, 2, 3, 4, 5, 7, 10, 12, 16, 17, 20)), *_near(dots, (0, 1, 2, 3, 4)), *(float(word in h) for h in _HINTS),
    ]


def nodes(text: str) -> Nodes:
    out = Nodes([], [], [], [])
    if not _TELLING.search(text):
        return out
    tokens = [(m.start(), m.group()) for m in _TOKEN.finditer(text)]
    for place, (start, token) in enumerate(tokens):
        if not _TELLING.search(token):
            continue
        core = token.rstrip(_EDGES)
        start += len(core)
        core = core.lstrip(_EDGES)
        start -= len(core)
        digits = _NOT_DIGIT.sub("", core)
        out.spans.append((start, start + len(core)))
        out.places.append(place)
        out.keys.append((digits if len(digits) >= 6 and "@" not in core else core.lower(), _DIGIT.sub("9", _LETTERS.sub("a", core))))
        out.shapes.append(_shape(core, digits, tokens[place - 1][1] if place else "", tokens[place + 1][1] if place + 1 < len(tokens) else ""))
    return out


class Graph(NamedTuple):
    """Edges (node, node, type) of tokens, numbered in order, and of hubs, numbered from -1 downwards."""

    edges: list[tuple[int, int, int]]
    hubs: int


def graph(found: list[Nodes]) -> Graph:
    """Chain edges between neighbouring tokens; an edge from each token to the hub of its key, for keys of two and more tokens."""
    out, first, hubs = [], 0, 0
    for each in found:
        out += [(first + i - 1, first + i, CHAIN) for i in range(1, len(each.places)) if each.places[i - 1] == each.places[i] - 1]
        for kind in (SAME, ALIKE):
            members: dict[str, list[int]] = {}
            for i, keys in enumerate(each.keys):
                if keys[kind - 1]:
                    members.setdefault(keys[kind - 1], []).append(first + i)
            for own in members.values():
                if len(own) > 1:
                    hubs += 1
                    out += [(i, -hubs, kind) for i in own]
        first += len(each.places)
    return Graph(out, hubs)


class Model(NamedTuple):
    """weight: features by labels (none, then KINDS); pair: log potentials of chain edges and of the two kinds of skip edges (token by hub)."""

    weight: np.ndarray
    pair: np.ndarray


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def marginals(unary: np.ndarray, links: np.ndarray, pair: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities by damped loopy message passing in logarithms; links has rows (node, node, type), negative numbers count from the end."""
    if not len(links):
        return _softmax(unary)
    one, other = links[:, 0] % len(unary), links[:, 1] % len(unary)
    source, target = np.concatenate([one, other]), np.concatenate([other, one])
    table = np.concatenate([pair[links[:, 2]], pair[links[:, 2]].transpose(0, 2, 1)])
    back = np.roll(np.arange(len(source)), len(links))
    n, k = unary.shape
    message = np.zeros((len(source), k))
    for _ in range(rounds):
        belief = unary + np.stack([np.bincount(target, message[:, c], n) for c in range(k)], axis=1)
        cavity = (belief[source] - message[back])[:, :, None] + table
        top = cavity.max(axis=1)
        new = top + np.log(np.exp(cavity - top[:, None]).sum(axis=1))
        step = (1 - DAMPING) * (new - new.mean(axis=1, keepdims=True) - message)
        message += step
        if np.abs(step).max() < SETTLED:
            break
    return _softmax(unary + np.stack([np.bincount(target, message[:, c], n) for c in range(k)], axis=1))


def _surplus(met: np.ndarray, share: np.ndarray, bound: float, agree: float) -> np.ndarray:
    """Log of how much more often labels meet than by chance; where few met, by chance and, in part, only with their like."""
    before = (1 - agree) * np.outer(share, share) + agree * np.diag(share)
    seen = (met + PRIOR * before) / (met.sum() + PRIOR)
    return np.clip(np.log(seen) - np.log(np.outer(seen.sum(axis=1), seen.sum(axis=0))), -bound, bound)


def potentials(labels: np.ndarray, found: Graph) -> np.ndarray:
    """Tables of the three kinds of edges from known labels (-1: unknown). A hub stands for what most others of its tokens are; each hub weighs as one."""
    k = len(KINDS) + 1
    met = np.zeros((3, k, k))
    members: dict[int, list[int]] = {}
    kind_of: dict[int, int] = {}
    for a, b, kind in found.edges:
        if kind != CHAIN:
            kind_of[b] = kind
            if labels[a] >= 0:
                members.setdefault(b, []).append(int(labels[a]))
        elif labels[a] >= 0 and labels[b] >= 0:
            met[CHAIN, labels[a], labels[b]] += 1
    for hub, own in members.items():
        count = np.bincount(own, minlength=k)
        for y in np.flatnonzero(count) if len(own) > 1 else ():
            others = count - np.eye(k, dtype=np.int64)[y]
            most = others == others.max()
            met[kind_of[hub], y] += count[y] / len(own) * most / most.sum()
    share = (np.bincount(labels[labels >= 0], minlength=k) + 1) / ((labels >= 0).sum() + k)
    return np.stack([_surplus(m, share, bound, agree) for m, bound, agree in zip(met, BOUNDS, AGREE, strict=True)])


def train(texts: list[str], passes: int = 300) -> Model:
    """Piecewise: a softmax on shapes for the tokens, label meetings for the edges."""
    found, labels = [nodes(t) for t in texts], []
    for text, each in zip(texts, found, strict=True):
        spans, open_to = base_spans(text), failed_spans(text)
        for start, end in each.spans:
            unknown = any(a < end and start < b for a, b in open_to)
            labels.append(next((kind + 1 for a, kind, b in spans if a < end and start < b), -1 if unknown else 0))
    k = len(KINDS) + 1
    every = np.array(labels, np.int64)
    known = every >= 0
    if not known.any():
        return Model(np.zeros((0, k)), np.zeros((3, k, k)))
    x, y = np.array([x for each in found for x in each.shapes])[known], every[known]
    goal = np.eye(k)[y]
    weight, speed = np.zeros((x.shape[1], k)), np.zeros((x.shape[1], k))
    for _ in range(passes):
        speed = 0.9 * speed + x.T @ (goal - _softmax(x @ weight)) / len(x) - 1e-4 * weight
        weight += 1.0 * speed
    return Model(weight, potentials(every, graph(found)))


def beliefs(found: list[Nodes], model: Model) -> np.ndarray:
    """Label probabilities of all tokens of some texts."""
    own = np.array([x for each in found for x in each.shapes]) @ model.weight
    linked = graph(found)
    return marginals(np.concatenate([own, np.zeros((linked.hubs, own.shape[1]))]), np.array(linked.edges, np.int64).reshape(-1, 3), model.pair)[: len(own)]


def _valid(kind: int, value: str) -> bool:
    digits = len(_NOT_DIGIT.sub("", value))
    if kind == 0:
        return value.find("@") > 0 and "." in value[value.find("@") + 2 : -1]
    if kind == 1:
        return re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", value) is not None
    return 12 <= digits <= 19 if kind == 2 else 7 <= digits <= 15


def find(texts: list[str], model: Model) -> list[list[tuple[Span, bool]]]:
    """Per text: spans in order, each with whether it is a base one."""
    base, found = [base_spans(t) for t in texts], [nodes(t) for t in texts]
    labels = [0] * sum(len(each.spans) for each in found)
    if labels and len(model.weight):
        sure = beliefs(found, model)
        labels = np.where(sure.max(axis=1) >= SURE, sure.argmax(axis=1), 0).tolist()
    out, first = [], 0
    for text, spans, each in zip(texts, base, found, strict=True):
        own, first = labels[first : first + len(each.spans)], first + len(each.spans)
        added, i = [], 0
        while i < len(own):
            j = i + 1
            while own[i] == 4 and j < len(own) and own[j] == 4 and each.places[j] == each.places[j - 1] + 1 and text[each.spans[j][0]] != "+":
                j += 1  # only telephone numbers have several tokens
            (start, _), (_, end) = each.spans[i], each.spans[j - 1]
            if own[i] and _valid(own[i] - 1, text[start:end]) and not any(a < end and start < b for a, _, b in spans):
                added.append((start, own[i] - 1, end))
            i = j
        out.append(sorted([(s, True) for s in spans] + [(s, False) for s in added]))
    return out


def _as_texts(texts: pa.Array) -> list[str]:
    return [t or "" for t in texts.to_pylist()]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAINING_ROWS) -> Model:
    """A model from at most `rows` documents with candidate tokens, those with the smallest hash of their id."""
    telling = docs.filter(F.col(text_col).rlike("[0-9@+]") & F.col(id_col).isNotNull())
    chosen = telling.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(rows)
    sample = bounded(telling, chosen.withColumn("_y", F.lit(0)), id_col, text_col)
    return Model(*fitted(sample, lambda texts, _: train([t.decode() for t in texts])))


def spans(docs: DataFrame, model: Model, text_col: str = "text", to: str = "spans") -> DataFrame:
    """docs with their spans: kind, start and end (code points, end exclusive) and whether a pattern found it."""
    shared = tuned(docs.sparkSession).sparkContext.broadcast(tuple(model))

    @F.arrow_udf(_SPANS)
    def found(texts: pa.Array) -> pa.Array:
        rows = find(_as_texts(texts), Model(*shared.value))
        return pa.array([[{"kind": KINDS[k], "start": a, "end": b, "base": base} for (a, k, b), base in row] for row in rows], _ARROW)

    return docs.withColumn(to, found(F.col(text_col)))


def listed(spans_col: str = "spans", base_only: bool = False) -> Column:
    """kind:start:end of each span, comma-joined."""
    chosen = F.filter(F.col(spans_col), lambda s: s["base"]) if base_only else F.col(spans_col)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(kind: str, spans_col: str = "spans") -> Column:
    """Base spans of a kind."""
    return F.size(F.filter(F.col(spans_col), lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def redacted(text: str, row: list[tuple[Span, bool]]) -> str:
    """text with each span, or each chain of overlapping ones, replaced by its first kind in brackets."""
    out, done, i = [], 0, 0
    while i < len(row):
        (start, kind, end), _ = row[i]
        i += 1
        while i < len(row) and row[i][0][0] < end:
            end = max(end, row[i][0][2])
            i += 1
        out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = end
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with all spans replaced by their kinds; null texts stay null."""
    shared = tuned(docs.sparkSession).sparkContext.broadcast(tuple(model))

    @F.arrow_udf(T.StringType())
    def cleaned(texts: pa.Array) -> pa.Array:
        own = _as_texts(texts)
        rows = find(own, Model(*shared.value))
        return pa.array([None if missing else redacted(t, row) if row else t for t, row, missing in zip(own, rows, texts.is_null().to_pylist(), strict=True)], pa.string())

    return docs.withColumn(text_col, cleaned(F.col(text_col)))
