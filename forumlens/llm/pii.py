"""Personal data by fixed patterns and a skip-chain conditional random field.

The base patterns find e-mail addresses, IPv4 addresses, payment cards (Luhn) and international phone numbers; their
spans always stay. The field adds spans that the patterns miss: a number written another way at its second mention,
an address with a bracketed "at", a phone number without its plus sign.

Nodes are all candidate tokens of a document, in order: base spans and tokens that look like one (numbers of 7 to 19
digits with separators, four numbers of at most 255, words around an at sign). Labels are "none" and the four kinds; a base span's node is
observed. Potentials:

* node: a softmax regression on the shape (digits, groups, separators, checks, the word in front). It is trained on the
  shapes of base spans against other candidates; the plus sign of a phone number is left out of the shape, so that
  it can be recognised without one. Targets are smoothed, as an unmatched candidate may be personal data all the same;
* chain: neighbouring candidates that are at most ``NEAR`` characters apart;
* skip: all candidates of a document that are equal or similar (same address without case, same four parts of an IPv4
  address however they are separated, same last ten digits of another number) share
  one cluster variable, which each of them pulls to its label. That is one edge per token and not one per pair.

Loopy sum-product messages run over all documents of an Arrow batch at once, damped, for ``ROUNDS`` rounds; a
candidate becomes a span if a kind reaches ``THRESHOLD`` belief. Chain and skip weights are smoothed log odds of how
often base spans of the sample agree.

Fitting is bounded: about ``SAMPLE`` documents, chosen by a hash of id and text (equal rows once) and read whole, whose distinct shapes and
label pairs are counted by Spark; only these counts come to the driver.

Results on edges: null and empty texts have no spans. Positions are code points, ends exclusive. Every search is
linear in the text, whatever it holds. Repeated rows get equal spans. With nothing to learn from, no span is added.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from forumlens.llm.common import BOOK, append_from_texts, col, hash_sample, table

KINDS = ("email", "ip", "card", "phone")
NONE = 0                                  # label 0; the kinds are 1 to 4
SAMPLE = 20_000
NEAR = 80
ROUNDS = 12
DAMPING = 0.3
THRESHOLD = 0.8
SMOOTH = 0.03                             # share of the target that is spread over all labels
MAX_WEIGHT = 5.0

# --- base patterns ------------------------------------------------------------------------------------
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a match cannot begin inside a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_NOT_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses, found from their at signs."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            floor = match.end()
            found.append((start, floor))
        at = text.find("@", max(at + 1, floor))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or "0") < 256


def four_bytes(groups: list[str]) -> bool:
    """Whether runs of digits are the parts of an IPv4 address."""
    return len(groups) == 4 and all(map(_byte, groups))


def is_candidate(token: str) -> bool:
    """Numbers of 7 to 19 digits, and four parts of an address with any digits."""
    groups = _DIGITS.findall(token)
    return 7 <= sum(map(len, groups)) <= 19 or four_bytes(groups)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, label) by start, then kind."""
    spans = [(a, b, 1) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            spans += [(*m.span(), 2) for m in _IP.finditer(text) if all(_byte(p) for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start():
                digits = _NOT_DIGIT.sub("", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append((*m.span(), 3))
        if "+" in text:
            spans += [(*m.span(), 4) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    spans.sort(key=lambda s: (s[0], s[2]))
    return spans


# --- candidates and their shapes ----------------------------------------------------------------------
_NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[\x20().-]{0,2}[0-9])+")
_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}", re.I)
_AT_SIGN = re.compile(r"@|\[at\]|\(at\)|\{at\}", re.I)
_CUES = {"email": "mail e-mail email contact write", "ip": "ip host server address node", "card": "card visa mastercard credit debit pan",
         "phone": "tel phone call fax mobile telephone telefon"}      # fixed values: words in front that hint at a kind
_CUE_OF = {word: kind for kind, words in _CUES.items() for word in words.split()}
_WORD_BEFORE = re.compile(r"([A-Za-z-]{2,20})[^A-Za-z0-9\n]{0,4}$")


class Node(NamedTuple):
    start: int
    end: int
    label: int          # of a base span, else -1
    shape: tuple
    key: str            # equal for similar tokens; empty: similar to none


def shape_of(text: str, start: int, end: int) -> tuple[tuple, str]:
    """Shape and similarity key of a candidate."""
    token = text[start:end]
    before = _WORD_BEFORE.search(text[max(0, start - 26):start])
    cue = _CUE_OF.get(before.group(1).lower(), "") if before else ""
    sign = _AT_SIGN.search(token)
    if sign:
        domain = token[sign.end():].strip()
        return (("mail", "dot" if "." in domain else "no dot", "", "", cue),
                "m" + re.sub(r"\s", "", token[:sign.start()] + "@" + domain).lower())
    digits = _NOT_DIGIT.sub("", token)
    groups = _DIGITS.findall(token)
    separators = "".join(s for s in " .-(" if s in token)
    four = four_bytes(groups)
    check = "ip" if four and separators == "." else "luhn" if len(digits) >= 12 and luhn(digits) else ""
    key = "i" + ".".join(g.lstrip("0") or "0" for g in groups) if four else f"d{digits[-10:]}" if len(digits) >= 7 else ""
    lengths = "-".join(str(len(g)) for g in groups[-3:])
    return ("number", str(min(len(digits), 20)), lengths, separators + check, cue), key


def nodes_of(text: str) -> list[Node]:
    """Base spans and other candidates, by start. Candidates that touch a base span are left out."""
    base = base_spans(text)
    nodes = [Node(a, b, label, *shape_of(text, a, b)) for a, b, label in base]
    others: list[tuple[int, int]] = []
    if _DIGIT.search(text):
        others = [m.span() for m in _NUMBER.finditer(text) if m.end() - m.start() >= 7 and is_candidate(m.group())]
    if "@" in text or "at" in text and _AT_SIGN.search(text):
        others += _around_at(text)
    if others:
        taken = sorted((a, b) for a, b, _ in base)
        starts = [a for a, _ in taken]
        furthest = np.maximum.accumulate([b for _, b in taken]) if taken else []
        for a, b in sorted(set(others)):
            i = int(np.searchsorted(starts, b))               # base spans that begin before the candidate ends
            if i == 0 or furthest[i - 1] <= a:
                nodes.append(Node(a, b, -1, *shape_of(text, a, b)))
    nodes.sort(key=lambda n: (n.start, n.label))
    return nodes


def _around_at(text: str) -> list[tuple[int, int]]:
    """Words around an at sign, looked for in a window before each sign, so that the search stays linear."""
    found = []
    for sign in _AT_SIGN.finditer(text):
        window = max(0, sign.start() - 65)
        for match in _AT.finditer(text, window, min(len(text), sign.end() + 600)):
            if match.start() < sign.start() < match.end():
                found.append(match.span())
                break
    return found


# --- the field ----------------------------------------------------------------------------------------
LABELS = len(KINDS) + 1


class Field(NamedTuple):
    """Weights of shape parts (place and value) per label, and the two agreement weights."""
    parts: dict[tuple[int, str], np.ndarray]
    bias: np.ndarray
    chain: np.ndarray
    skip: float


def parts_of(shape: tuple) -> list[tuple[int, str]]:
    kind = shape[0]
    return [(i, f"{kind}:{value}") for i, value in enumerate(shape)]


def node_scores(field: Field, shape: tuple) -> np.ndarray:
    zero = np.zeros(LABELS)
    return field.bias + sum((field.parts.get(p, zero) for p in parts_of(shape)), zero)


def train(shapes: dict[tuple[tuple, int], int], chain: dict[tuple[int, int], int], same: int, different: int,
          steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Softmax regression over counted shapes by full-batch gradient steps; log odds for the edges."""
    if not shapes:
        return Field({}, np.zeros(LABELS), np.zeros((LABELS, LABELS)), 0.0)
    number: dict[tuple[int, str], int] = {}
    rows = sorted(shapes.items(), key=str)
    places = [[number.setdefault(p, len(number)) for p in parts_of(shape)] for (shape, _), _ in rows]
    x = np.zeros((len(rows), len(number) + 1))
    x[:, -1] = 1
    for i, place in enumerate(places):
        x[i, place] = 1
    y = np.full((len(rows), LABELS), SMOOTH / LABELS)
    y[np.arange(len(rows)), [max(label, 0) for (_, label), _ in rows]] += 1 - SMOOTH
    weight = np.sqrt(np.array([n for _, n in rows], float))   # frequent shapes count more, but not all alone
    weight /= weight.sum()
    w = np.zeros((x.shape[1], LABELS))
    speed = np.zeros_like(w)
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed - rate * (x.T @ ((p - y) * weight[:, None]) + decay * w)
        w = w + speed
    together = np.full((LABELS, LABELS), 1.0)
    for (a, b), n in chain.items():
        together[a, b] += n
    expected = together.sum(1, keepdims=True) * together.sum(0, keepdims=True) / together.sum()
    edges = np.clip(0.25 * np.log(together / expected), -1, 1)  # neighbours are weak evidence
    return Field({p: w[i] for p, i in number.items()}, w[-1], edges,
                 float(np.clip(np.log((same + 20) / (different + 1)), 0, MAX_WEIGHT)))


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return (np.log(np.exp(values - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def beliefs(own: np.ndarray, left: np.ndarray, right: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Beliefs of all variables. ``own``: log potentials; edge e joins left[e] and right[e] by tables[e]."""
    n = len(own)
    forth, back = np.zeros((len(left), LABELS)), np.zeros((len(left), LABELS))
    total = own.copy()
    for _ in range(ROUNDS if len(left) else 0):
        total = own.copy()
        np.add.at(total, right, forth)
        np.add.at(total, left, back)
        new_forth = _log_sum((total[left] - back)[:, :, None] + tables, 1)
        new_back = _log_sum((total[right] - forth)[:, None, :] + tables, 2)
        forth = DAMPING * forth + (1 - DAMPING) * (new_forth - _log_sum(new_forth, 1)[:, None])
        back = DAMPING * back + (1 - DAMPING) * (new_back - _log_sum(new_back, 1)[:, None])
    if len(left):
        total = own.copy()
        np.add.at(total, right, forth)
        np.add.at(total, left, back)
    return np.exp(total - _log_sum(total, 1)[:, None]) if n else own


def label_nodes(documents: list[list[Node]], field: Field) -> list[list[int]]:
    """Labels of the nodes of each document; base spans keep theirs."""
    own, left, right, tables, place = [], [], [], [], {}
    skip = np.eye(LABELS) * field.skip
    known: dict[tuple, np.ndarray] = {}
    for d, nodes in enumerate(documents):
        if not any(n.label < 0 for n in nodes):
            continue                                            # nothing to decide
        first = len(own)
        place[d] = first
        for node in nodes:
            if node.label >= 0:
                score = np.full(LABELS, -30.0)
                score[node.label] = 0
            else:
                if node.shape not in known:
                    known[node.shape] = node_scores(field, node.shape)
                score = known[node.shape]
            own.append(score)
        for i in range(1, len(nodes)):
            if nodes[i].start - nodes[i - 1].end <= NEAR:
                left.append(first + i - 1)
                right.append(first + i)
                tables.append(field.chain)
        sizes = Counter(n.key for n in nodes if n.key)
        hubs: dict[str, int] = {}
        for i, node in enumerate(nodes):
            if sizes.get(node.key, 0) > 1:
                if node.key not in hubs:
                    hubs[node.key] = len(own)
                    own.append(np.zeros(LABELS))
                left.append(first + i)
                right.append(hubs[node.key])
                tables.append(skip)
    found = (beliefs(np.array(own), np.array(left, np.int64), np.array(right, np.int64), np.array(tables).reshape(-1, LABELS, LABELS))
             if own else np.zeros((0, LABELS)))
    out = []
    for d, nodes in enumerate(documents):
        labels = [n.label for n in nodes]
        for i, node in enumerate(nodes):
            if node.label < 0:
                belief = found[place[d] + i]
                best = int(belief.argmax())
                labels[i] = best if best != NONE and belief[best] >= THRESHOLD and field.parts else NONE
        out.append(labels)
    return out


# --- Spark ----------------------------------------------------------------------------------------------
SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()),
                   StructField("base", BooleanType())])


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Field:
    """Learn the weights from the base spans of a sample."""
    rows = docs.select(F.count(F.lit(1))).first()[0]
    chosen = hash_sample(docs.select(col(key), col(text)), [key, text], sample, rows, salt=3).dropDuplicates()

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for content in batch.column(0).to_pylist():
                nodes = nodes_of(content) if content else []
                seen: dict[str, int] = {}
                for i, node in enumerate(nodes):
                    counts["shape", *node.shape, str(max(node.label, 0))] += 1
                    if i and node.start - nodes[i - 1].end <= NEAR:
                        counts["chain", str(max(nodes[i - 1].label, 0)), str(max(node.label, 0))] += 1
                    if node.key and node.label >= 0:       # pairs of base spans; of others the label is not known
                        if node.key in seen:
                            counts["same" if seen[node.key] == node.label else "different",] += 1
                        seen[node.key] = node.label
        rows = list(counts.items())
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k, _ in rows], pa.list_(pa.string())),
                                          pa.array([n for _, n in rows], pa.int64())], ["what", "n"])

    found = (chosen.select(col(text).cast("string")).mapInArrow(run, "what array<string>, n long")
             .groupBy("what").agg(F.sum("n").alias("n")).collect())
    counted = {tuple(r["what"]): r["n"] for r in found}
    return train({(k[1:-1], int(k[-1])): n for k, n in counted.items() if k[0] == "shape"},
                 {(int(k[1]), int(k[2])): n for k, n in counted.items() if k[0] == "chain"},
                 counted.get(("same",), 0), counted.get(("different",), 0))


def spans_of(texts: list[str | None], field: Field) -> list[list[dict]]:
    """All spans of each text, by start, then kind."""
    documents = [nodes_of(t) if t else [] for t in texts]
    out = []
    for nodes, labels in zip(documents, label_nodes(documents, field)):
        spans = [(n.start, label, n.end, n.label >= 0) for n, label in zip(nodes, labels) if label != NONE]
        out.append([{"kind": KINDS[label - 1], "start": a, "end": b, "base": base} for a, label, b, base in sorted(spans)])
    return out


def find(docs: DataFrame, field: Field, text: str = "text", out: str = "spans", keep: list[str] | None = None) -> DataFrame:
    """Append the list of spans of every text. The weights, a few kB, go along with the tasks; no shuffle."""
    return append_from_texts(docs, text, [StructField(out, ArrayType(SPAN))], lambda texts: [spans_of(texts, field)], keep)


def masked(text: str | None, spans: list[dict]) -> str | None:
    """The text with every span replaced by its kind in brackets; spans that overlap become one, named by the first."""
    if not spans:
        return text
    parts, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]["start"], spans[i]["end"], spans[i]["kind"]
        i += 1
        while i < len(spans) and spans[i]["start"] < end:
            end = max(end, spans[i]["end"])
            i += 1
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(parts) + text[at:]


def mask(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """The table with every span of its texts masked; other columns and their order stay."""
    others = [c for c in docs.columns if c != text]
    done = append_from_texts(docs, text, [StructField("__masked", StringType())],
                             lambda texts: [[masked(t, s) for t, s in zip(texts, spans_of(texts, field))]], others)
    return done.select(*[(F.col("__masked").alias(text) if c == text else col(c)) for c in docs.columns])


def joined(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@BOOK.add("op3_skip_chain_pii")
def skip_chain_pii(spark, sf_dir):
    """Personal data of every document: counts and digest of the base spans, all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, fit(docs), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])

    def number_of(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number_of(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))
