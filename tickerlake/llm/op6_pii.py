"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

The patterns find e-mail addresses, IP addresses, payment cards and phone numbers.  The tagger looks at tokens
around anything with a digit, an at sign or a written-out "at", knows them by their shapes and their neighbours'
shapes, and is trained from a small labelled table by gradient steps on the conditional likelihood.  It is decoded
by Viterbi steps for many windows at once.  Its spans are added where they touch no span of the patterns.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerlake.llm import common
from tickerlake.llm.pii_labelled import SENTENCES

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
DIMENSIONS = 1 << 13
EPOCHS = 40
STEP, RIDGE = 0.1, 1e-4
#: Tokens on either side of a trigger that the tagger sees at first.
CONTEXT = 7
#: A span that comes as near to the end of a window, in tokens, is decoded again with more tokens there.
MARGIN = 4
#: Tokens that a window has at first, at most; longer stretches are decoded in windows that share CONTEXT tokens.
LONGEST = 512
#: Tokens, at least, of the windows whose features are held at once.
DECODED = 1 << 16
SLICE_BYTES = 4_000_000

# The base patterns.
# An address takes whole runs of digits, so that one which fails at a run's start fails at all its digits.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
TRIGGER = re.compile(r"[0-9]+|@|[\[({]\s?at\s?[\])}]", re.I)


def luhn(digits: str) -> bool:
    values = [ord(c) - 48 for c in reversed(digits)]
    return sum(values[::2] + [2 * v - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def small(part: str) -> bool:
    """A number of at most 255, of whatever length it is written."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their at signs: an address starts where the characters before
    the at sign that it may have begin, and no other start can succeed when this one fails."""
    out, at, behind = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > behind and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            behind = m.end()
        else:
            behind = max(behind, at + 1)
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind."""
    found = [(a, b, "email") for a, b in emails(text)]
    found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found, key=order)


def order(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def shape(token: str) -> str:
    """Digits by their number, letters as runs of x and X."""
    if token.isdigit():
        return f"d{min(len(token), 12)}"
    return re.sub(r"(.)\1+", r"\1+", re.sub(r"[0-9]", "d", re.sub(r"[^\W\d_]", lambda m: "X" if m[0].isupper() else "x", token)))


def features(tokens: list[str], tight: list[bool]) -> list[list[int]]:
    """Numbers of the active features of every token; tight: whether it follows the one before without a gap."""
    shapes = [shape(t) for t in tokens]
    n, out = len(tokens), []
    for i in range(n):
        def near(k, what):
            return what[i + k] if 0 <= i + k < n else ""

        before, after = tight[i], near(1, tight) is True
        names = ["bias", f"s0 {shapes[i]}", f"w0 {tokens[i].lower()[:8]}", f"t {before}{after}"]
        names += [f"s{k} {near(k, shapes)}" for k in (-2, -1, 1, 2)] + [f"w{k} {near(k, tokens).lower()[:8]}" for k in (-3, -2, -1, 1)]
        names += [f"s-0 {near(-1, shapes)} {shapes[i]} {before}", f"s0+ {shapes[i]} {near(1, shapes)} {after}", f"s-0+ {near(-1, shapes)} {shapes[i]} {near(1, shapes)}"]
        out.append([zlib.crc32(x.encode()) % DIMENSIONS for x in names])
    return out


def tokenized(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    spans = [m.span() for m in TOKEN.finditer(text)]
    return [text[a:b] for a, b in spans], spans


def gaps(spans: list[tuple[int, int]]) -> list[bool]:
    return [i > 0 and spans[i][0] == spans[i - 1][1] for i in range(len(spans))]


def labelled() -> list[tuple[list[list[int]], list[int]]]:
    """Features and labels of the labelled sentences."""
    out = []
    for line in filter(None, SENTENCES.split("\n")):
        text, marks, rest = "", [], line
        while m := re.search(r"\[(email|ip|card|phone) ", rest):
            text += rest[: m.start()]
            depth, end = 1, m.end()
            while depth:
                depth += {"[": 1, "]": -1}.get(rest[end], 0)
                end += 1
            marks.append((len(text), len(text) + end - 1 - m.end(), m[1]))
            text, rest = text + rest[m.end() : end - 1], rest[end:]
        text += rest
        tokens, spans = tokenized(text)
        labels = [0] * len(tokens)
        for a, b, kind in marks:
            inside = [i for i, (x, y) in enumerate(spans) if a <= x and y <= b]
            for i in inside:
                labels[i] = LABELS.index(("B-" if i == inside[0] else "I-") + kind)
        out.append((features(tokens, gaps(spans)), labels))
    return out


def allowed() -> np.ndarray:
    """(from, to) 0 where a label may follow, else a large negative number; the last row is the start."""
    out = np.zeros((len(LABELS) + 1, len(LABELS)))
    for j, label in enumerate(LABELS):
        if label.startswith("I-"):
            out[[i for i, x in enumerate((*LABELS, "")) if x[2:] != label[2:]], j] = -1e9
    return out


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@functools.cache
def trained() -> tuple[np.ndarray, np.ndarray]:
    """(feature, label) weights and (from, to) moves, by steps on the conditional likelihood of the labelled table."""
    data, fixed, k = labelled(), allowed(), len(LABELS)
    weights, moves = np.zeros((DIMENSIONS, k)), np.zeros((k + 1, k))
    square_w, square_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    for _ in range(EPOCHS):
        for feats, labels in data:
            n, idx = len(labels), np.array(feats)
            emit, go = weights[idx].sum(axis=1), moves + fixed
            ahead, behind = np.zeros((n, k)), np.zeros((n, k))
            ahead[0] = go[k] + emit[0]
            for i in range(1, n):
                ahead[i] = emit[i] + log_sum(ahead[i - 1][:, None] + go[:k], 0)
            for i in range(n - 2, -1, -1):
                behind[i] = log_sum(go[:k] + (emit[i + 1] + behind[i + 1])[None], 1)
            z = log_sum(ahead[-1], 0)
            own = -np.exp(ahead + behind - z)
            own[np.arange(n), labels] += 1
            step = np.zeros_like(moves)
            step[k] -= np.exp(ahead[0] + behind[0] - z)
            step[k, labels[0]] += 1
            for i in range(1, n):
                step[:k] -= np.exp(ahead[i - 1][:, None] + go[:k] + (emit[i] + behind[i])[None] - z)
                step[labels[i - 1], labels[i]] += 1
            grad = np.zeros((DIMENSIONS, k))
            np.add.at(grad, idx.ravel(), np.repeat(own, idx.shape[1], axis=0))
            rows = np.unique(idx)
            grad = grad[rows] - RIDGE * weights[rows]
            square_w[rows] += grad**2
            weights[rows] += STEP * grad / np.sqrt(square_w[rows])
            square_m += step**2
            moves += STEP * step / np.sqrt(square_m)
    return weights, moves + fixed


def viterbi(windows: list[list[list[int]]], model: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Best labels of every window; windows are decoded together, the longest first, each until its own end."""
    weights, go = model
    k, sizes = len(LABELS), np.array([len(w) for w in windows], dtype=np.int64)
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(windows)
    for chosen in [np.argsort(-sizes, kind="stable")] if len(windows) else []:
        size = sizes[chosen]
        flat = np.array([f for c in chosen for token in windows[c] for f in token], dtype=np.int64).reshape(int(size.sum()), -1)
        emit = np.zeros((len(flat), k))
        for column in flat.T:
            emit += weights[column]
        first = np.cumsum(size) - size
        best = go[k] + emit[first]
        back = []
        for i in range(1, int(size[0])):
            n = int(np.searchsorted(-size, -i, side="left"))  # windows longer than i
            paths = best[:n, :, None] + go[None, :k]
            back.append(paths.argmax(axis=1).astype(np.int8))
            best[:n] = paths.max(axis=1) + emit[first[:n] + i]
        last = best.argmax(axis=1)
        labels = [np.zeros(s, np.int64) for s in size]
        for w, n in enumerate(size.tolist()):
            at = int(last[w])
            for i in range(n - 1, -1, -1):
                labels[w][i] = at
                if i:
                    at = int(back[i - 1][w, at])
        for c, x in zip(chosen, labels):
            out[c] = x
    return out


def windows_of(text: str) -> list[tuple[list[str], list[tuple[int, int]]]]:
    """Tokens (with their places) within CONTEXT tokens of a trigger, overlapping stretches merged."""
    triggers = [m.start() for m in TRIGGER.finditer(text)]
    if not triggers:
        return []
    reach = 80  # characters on either side that are sure to hold CONTEXT tokens of usual length
    parts: list[list[int]] = []
    for t in triggers:
        if parts and t - reach <= parts[-1][1]:
            parts[-1][1] = t + reach
        else:
            parts.append([t - reach, t + reach])
    out = []
    for a, b in parts:
        a, b = max(a, 0), min(b, len(text))
        while a > 0 and text[a - 1].isalnum():
            a -= 1
        while b < len(text) and text[b].isalnum():
            b += 1
        tokens, spans = tokenized(text[a:b])
        spans = [(x + a, y + a) for x, y in spans]
        here = [i for i, t in enumerate(tokens) if TRIGGER.search(t) or (t.lower() == "at" and i and tokens[i - 1] in "[({")]
        keep: list[list[int]] = []
        for i in here:
            if keep and i - CONTEXT <= keep[-1][1]:
                keep[-1][1] = i + CONTEXT + 1
            else:
                keep.append([max(i - CONTEXT, 0), i + CONTEXT + 1])
        out += [(tokens[i : min(i + LONGEST, y)], spans[i : min(i + LONGEST, y)]) for x, y in keep for i in range(x, max(y - CONTEXT, x + 1), LONGEST - CONTEXT)]
    return out


def longer(text: str, window: tuple[list[str], list[tuple[int, int]]], labels: np.ndarray, more: int) -> tuple[list[str], list[tuple[int, int]]] | None:
    """The window with more tokens on the sides where a span comes near its end, None if there is nothing to add."""
    tokens, spans = window
    before: list[tuple[int, int]] = []
    if labels[:MARGIN].any():
        a = b = spans[0][0]
        while a > 0 and len(before) <= more:
            a = max(a - 12 * more, 0)
            while a > 0 and text[a - 1].isalnum():
                a -= 1
            before = [m.span() for m in TOKEN.finditer(text, a, b)]
        before = before[-more:]
    behind = [m.span() for m in itertools.islice(TOKEN.finditer(text, spans[-1][1]), more)] if labels[-MARGIN:].any() else []
    if not before and not behind:
        return None
    return [text[a:b] for a, b in before] + tokens + [text[a:b] for a, b in behind], before + spans + behind


def decoded(texts: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, list[tuple[int, int]], np.ndarray]]:
    """(text, places of tokens, labels) of every window; windows grow, by twice as much each time, until their spans
    end inside them or the text ends."""
    todo = [(d, w) for d, text in enumerate(texts) for w in windows_of(text)]
    out, more = [], CONTEXT
    while todo:
        again = []
        for some in held(todo):
            for (d, w), labels in zip(some, viterbi([features(tokens, gaps(spans)) for _, (tokens, spans) in some], model)):
                if (wider := longer(texts[d], w, labels, more)) is None:
                    out.append((d, w[1], labels))
                else:
                    again.append((d, wider))
        todo, more = again, 2 * more
    return out


def held(todo: list) -> Iterator[list]:
    """The windows in lists of about DECODED tokens, one window at least."""
    some, size = [], 0
    for d, w in todo:
        some.append((d, w))
        size += len(w[0])
        if size >= DECODED:
            yield some
            some, size = [], 0
    if some:
        yield some


def plausible(kind: str, text: str) -> bool:
    """What a span of the tagger must have besides its labels."""
    digits = sum("0" <= c <= "9" for c in text)
    if kind == "email":
        return bool(re.search(r"@|\bat\b", text, re.I))
    if kind == "ip":
        return text.count(":") >= 2 and bool(re.fullmatch(r"[0-9A-Fa-f:.]+", text)) or bool(re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", text))
    return 13 <= digits <= 19 if kind == "card" else 7 <= digits <= 15


def tagged_spans(texts: list[str], taken: list[list[tuple[int, int, str]]], model: tuple[np.ndarray, np.ndarray]) -> list[list[tuple[int, int, str]]]:
    """The tagger's spans of every text that touch none of its taken spans."""
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for d, spans, labels in decoded(texts, model):
        i = 0
        while i < len(labels):
            if LABELS[labels[i]][0] == "B":
                kind, j = LABELS[labels[i]][2:], i + 1
                while j < len(labels) and LABELS[labels[j]] == f"I-{kind}":
                    j += 1
                a, b = spans[i][0], spans[j - 1][1]
                if plausible(kind, texts[d][a:b]) and all(b <= x or y <= a for x, y, _ in taken[d]):
                    found[d].append((a, b, kind))
                i = j
            else:
                i += 1
    return [apart(spans) for spans in found]


def apart(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of spans that overlap, as those of windows that grew into each other, the longest, then the first."""
    out: list[tuple[int, int, str]] = []
    starts: list[int] = []
    for a, b, kind in sorted(spans, key=lambda s: (s[0] - s[1], s[0], KINDS.index(s[2]))):
        at = bisect.bisect_left(starts, b)  # out is in order and without overlaps
        if not at or out[at - 1][1] <= a:
            out.insert(at, (a, b, kind))
            starts.insert(at, a)
    return out


def all_spans(texts: list[str], model: tuple[np.ndarray, np.ndarray]) -> tuple[list[list[tuple[int, int, str]]], list[list[tuple[int, int, str]]]]:
    """(base spans, all spans) of every text, each by start, then kind."""
    base = [base_spans(t) if TRIGGER.search(t) else [] for t in texts]
    added = tagged_spans(texts, base, model)
    return base, [sorted(set(b + a), key=order) for b, a in zip(base, added)]



def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) of every document: arrays of (start, end, kind), code points, end exclusive.

    docs: doc_id, text (further columns are ignored).  A null text is empty; repeated rows are repeated; an empty
    table gives an empty result.  Spans of one kind do not overlap, those of different kinds may.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        for batch in common.slices(batches, "text", SLICE_BYTES):
            both = all_spans(batch.column(1).to_pylist(), model.value)
            columns = [pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in spans] for spans in side], kind) for side in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "base", "spans"])

    span = "array<struct<start: long, end: long, kind: string>>"
    return common.documents(docs).mapInArrow(run, f"doc_id long, base {span}, spans {span}")


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span, overlapping ones together, replaced by its kind in brackets."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, personal data in ``text`` masked and ``n_chars`` counted anew; a null text stays."""
    model = docs.sparkSession.sparkContext.broadcast(trained())
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in common.slices(batches, "text", SLICE_BYTES):
            texts = batch.column(at).to_pylist()
            _, spans = all_spans([t or "" for t in texts], model.value)
            clean = [t if not s else mask(t, s) for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([pa.array(clean, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"))

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
