"""Personal data: fixed patterns, and a linear-chain conditional random field
over word shapes that adds what the patterns miss.

Only words with a digit or an ``@`` can belong to an entity; every other word is
fixed to the outside label.  The chain therefore splits exactly into runs of
such words, and Viterbi decodes all runs of a chunk at once, one numpy step a
position.  The field is trained (full-batch Adam on the forward-backward
gradient) on a small labelled table of at most ``sample_rows`` texts, by
default labelled by the patterns themselves, with copies whose phone numbers
lack the country code; training runs longer than
``train_run`` words are cut there.  Texts are scanned whole.

Pattern spans always stay; a decoded span is added when it overlaps none of
them and its word shapes hold the entity's own characters.  Offsets are code
points, ends exclusive.  Null and empty texts have no spans.  Repeated rows
give one result each, null ids pass through, an empty table gives an empty
result; without labelled words the field adds nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import LOW, UPPER
from .linear import adam

KINDS = ("email", "ip", "card", "phone")
#: labels: 0 outside, 1 + 2 k begin, 2 + 2 k inside of kind k
LABELS = 1 + 2 * len(KINDS)


@dataclass(frozen=True)
class Params:
    sample_rows: int = 3_000
    train_run: int = 64
    bits: int = 13
    steps: int = 60
    l2: float = 1e-4


# ------------------------------------------------------------------ patterns
LOCAL = frozenset(LOW + UPPER + "0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the pattern matches, by start, then kind."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:  # the local part is the run of its characters before the @
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        done = m.end() if m else at + 1
        if m:
            out.append((start, done, 0))
        at = text.find("@", done)
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    for m in PHONE.finditer(text):
        if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


def render(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2])))


# ------------------------------------------------------------------ features
CUE = np.zeros(256, dtype=bool)
CUE[48:58] = True
CUE[ord("@")] = True
LETTER = re.compile(r"[^\W\d_]")
EDGE = "\"'<>[]{}*&$#%|!?,;:."


def shape(word: str) -> str:
    """Letters to x or X, digits to 9; long words by their ends and length."""
    s = LETTER.sub("x", re.sub(r"[A-Z]", "X", re.sub(r"[0-9]", "9", word[:40])))
    return s if len(word) <= 40 else f"{s[:12]}~{len(word).bit_length()}"


def features(word: str, before: str, after: str) -> list[str]:
    core = word.strip(EDGE)
    s, digits = shape(core), NOT_DIGIT.sub("", core[:64])
    short = re.sub(r"(.)\1+", r"\1", s)
    parts = core.split(".")
    octets = len(parts) == 4 and all(x.isdigit() and x.isascii() and len(x) <= 3 and int(x) <= 255 for x in parts)
    pair = f"{short}|{re.sub(r'(.)\1+', r'\1', shape(after.strip(EDGE)))}"
    return ["1", f"s={s}", f"c={short}", f"n={min(len(digits), 20)}", f"@={'@' in core}", f"o={octets}",
            f"l={14 <= len(digits) <= 19 and luhn(digits)}", f"b={re.sub(r'(.)\1+', r'\1', shape(before))}",
            f"p={pair}", f"+={core[:1] == '+'}"]


N_FEATURES = 10


def _ids(rows: list[list[str]], bits: int) -> np.ndarray:
    if not rows:
        return np.zeros((0, N_FEATURES), np.int64)
    flat = pa.array([f"{j}:{x}" for r in rows for j, x in enumerate(r)])
    out = []
    for _, _, data, offs in K.chunks(flat):
        out.append(K.span_hash(data, offs[:-1], offs[1:]))
    return (np.concatenate(out) >> np.uint64(64 - bits)).astype(np.int64).reshape(-1, N_FEATURES)


@dataclass
class Words:
    """The cue words of some texts: text index, code point bounds, feature ids, and
    the first word of each run (with the end as a last bound)."""
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ids: np.ndarray
    bounds: np.ndarray


def cue_words(data: np.ndarray, offs: np.ndarray, bits: int) -> Words:
    s, e, d = K.runs(K.SOLID[data], offs)
    cue = np.concatenate([[0], np.cumsum(CUE[data])])
    at = np.flatnonzero(cue[e] > cue[s])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    raw = data.tobytes()
    word = lambda i: raw[s[i]:e[i]].decode("utf-8", "replace")
    rows = []
    for i in at:
        near = [word(j) if 0 <= j < len(s) and d[j] == d[i] and e[j] - s[j] <= 64 else "" for j in (i - 1, i + 1)]
        rows.append(features(word(i), *near))
    first = points[offs[d[at]]]
    new = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (np.diff(d[at]) > 0))) if len(at) else np.zeros(0, np.int64)
    return Words(d[at], points[s[at]] - first, points[e[at]] - first, _ids(rows, bits), np.append(new, len(at)))


# ------------------------------------------------------------------ the field
def _allowed() -> np.ndarray:
    """Inside labels follow only a begin or inside label of their kind."""
    ok = np.ones((LABELS, LABELS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


ALLOWED = _allowed()
START = ALLOWED[0]  # a run begins after an outside word
BAD = -1e9


@dataclass(frozen=True)
class Field:
    emit: np.ndarray  # 2**bits x LABELS
    step: np.ndarray  # LABELS x LABELS

    def decode(self, w: Words) -> np.ndarray:
        """The best label of each word (Viterbi over all runs at once)."""
        n = len(w.doc)
        labels = np.zeros(n, np.int64)
        if n == 0:
            return labels
        emit = self.emit[w.ids].sum(axis=1)
        step = np.where(ALLOWED, self.step, BAD)
        size = np.diff(w.bounds)
        order = np.argsort(-size, kind="stable")
        first, size = w.bounds[:-1][order], size[order]
        best = np.where(START, emit[first], BAD)
        back = [None]
        for t in range(1, size[0]):
            m = int(np.searchsorted(-size, -t, side="left"))  # runs longer than t
            cand = best[:m, :, None] + step[None]
            prev = cand.argmax(axis=1)
            best[:m] = np.take_along_axis(cand, prev[:, None, :], axis=1)[:, 0] + emit[first[:m] + t]
            back.append(prev)
        now = best.argmax(axis=1)
        for t in range(size[0] - 1, -1, -1):
            m = int(np.searchsorted(-size, -t, side="left"))
            labels[first[:m] + t] = now[:m]
            if t:
                now[:m] = np.take_along_axis(back[t], now[:m, None], axis=1)[:, 0]
        return labels


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(w: Words, y: np.ndarray, p: Params = Params()) -> Field | None:
    """Maximum likelihood of the labels y of the words of ``w``."""
    if len(y) == 0 or not y.any():
        return None
    first = w.bounds[:-1]
    size = np.minimum(np.diff(w.bounds), p.train_run)
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    longest, n = int(size[0]), len(first)
    alive = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest)]
    used = np.concatenate([first[:alive[t]] + t for t in range(longest)])
    dim = 1 << p.bits

    def grad(x: np.ndarray) -> np.ndarray:
        theta, step = x[:dim * LABELS].reshape(dim, LABELS), x[dim * LABELS:].reshape(LABELS, LABELS)
        emit = theta[w.ids].sum(axis=1)
        trans = np.where(ALLOWED, step, BAD)
        fwd = [np.where(START, emit[first], BAD)]
        for t in range(1, longest):
            m = alive[t]
            fwd.append(_lse(fwd[-1][:m, :, None] + trans[None], 1) + emit[first[:m] + t])
        ge, gs = np.zeros_like(emit), np.zeros_like(step)
        bwd = np.zeros((n, LABELS))
        z = np.zeros(n)
        for t in range(longest):
            m, nxt = alive[t], alive[t + 1] if t + 1 < longest else 0
            z[nxt:m] = _lse(fwd[t][nxt:m], 1)
        for t in range(longest - 1, -1, -1):
            m = alive[t]
            at = first[:m] + t
            ge[at] += np.exp(fwd[t] + bwd[:m] - z[:m, None])
            ge[at, y[at]] -= 1
            if t:
                inner = bwd[:m] + emit[at]
                both = fwd[t - 1][:m, :, None] + trans[None] + inner[:, None, :] - z[:m, None, None]
                gs += np.exp(both).sum(axis=0)
                np.add.at(gs, (y[at - 1], y[at]), -1)
                bwd[:m] = _lse(trans[None] + inner[:, None, :], 2)
        flat = (w.ids[used][:, :, None] * LABELS + np.arange(LABELS)).reshape(-1)
        g = np.bincount(flat, weights=np.repeat(ge[used][:, None, :], N_FEATURES, axis=1).reshape(-1),
                        minlength=dim * LABELS)
        return np.concatenate([g, np.where(ALLOWED, gs, 0).reshape(-1)]) / len(used) + p.l2 * x

    x = adam(grad, np.zeros(dim * LABELS + LABELS * LABELS), p.steps, rate=0.2)
    return Field(x[:dim * LABELS].reshape(dim, LABELS), x[dim * LABELS:].reshape(LABELS, LABELS))


def labels_of(w: Words, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """Begin and inside labels of the words that overlap a span of their text."""
    y = np.zeros(len(w.doc), np.int64)
    for i, d in enumerate(w.doc):
        for s, e, k in spans[d]:
            if s < w.end[i] and w.start[i] < e and y[i] == 0:
                inside = i and w.doc[i - 1] == d and w.start[i - 1] >= s - 1 and y[i - 1] in (1 + 2 * k, 2 + 2 * k) \
                    and w.end[i - 1] > s
                y[i] = 2 + 2 * k if inside else 1 + 2 * k
    first = w.bounds[:-1]
    y[first] -= (y[first] > 0) & (y[first] % 2 == 0)  # a run never begins inside
    return y


def labelled_table(texts: list[str]) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The sample texts with their pattern spans, and, for texts with phone
    numbers, two copies in which these lack the country code (which the
    patterns need): as written, and joined by hyphens."""
    out = []
    for t in texts:
        spans = pattern_spans(t)
        out.append((t, spans))
        for joined in (False, True):
            if not any(k == 3 for _, _, k in spans):
                break
            new, phones, at, size = [], [], 0, 0
            for s, e, k in spans:
                short = re.sub(r"^\+[0-9]+[ ().-]*?(?=[(0-9])", "", t[s:e]) if k == 3 and s >= at else ""
                if len(NOT_DIGIT.sub("", short)) < 7:
                    continue
                short = re.sub(r"[ ().-]+", "-", short.strip("(")) if joined else short
                new += [t[at:s], short]
                size += s - at
                phones.append((size, size + len(short), 3))
                size += len(short)
                at = e
            copy = "".join([*new, t[at:]])
            other = [x for x in pattern_spans(copy) if not any(a < x[1] and x[0] < b for a, b, _ in phones)]
            out.append((copy, other + phones))
    return out


def train(docs: DataFrame, p: Params = Params()) -> Field | None:
    """Fit on a bounded sample of the texts that hold a digit or an @, chosen by a
    hash of the text and labelled by the patterns."""
    cue = docs.filter(F.col("text").rlike("[0-9@]"))
    pick = (cue.select(F.xxhash64("text", F.lit("sample")).alias("_h")).distinct().orderBy("_h").limit(p.sample_rows))
    some = (cue.select("text", F.xxhash64("text", F.lit("sample")).alias("_h"))
            .join(F.broadcast(pick), "_h")  # at most sample_rows rows of 8 bytes
            .groupBy("_h").agg(F.first("text").alias("text")))
    table = labelled_table(some.orderBy("_h").toArrow()["text"].to_pylist())
    texts, spans = pa.array([t for t, _ in table], pa.string()), [x for _, x in table]
    parts, y, shift, base = [], [], 0, 0
    for lo, hi, data, offs in K.chunks(texts):
        w = cue_words(data, offs, p.bits)
        y.append(labels_of(w, spans[lo:hi]))
        parts.append(Words(w.doc + base, w.start, w.end, w.ids, w.bounds[:-1] + shift))
        shift += len(w.doc)
        base += hi - lo
    if not parts:
        return None
    cat = lambda f: np.concatenate([getattr(x, f) for x in parts])
    return fit(Words(cat("doc"), cat("start"), cat("end"), cat("ids"), np.append(cat("bounds"), shift)), np.concatenate(y), p)


# ------------------------------------------------------------------ detection
#: what may stand at the ends of a decoded span
OWN = (re.compile(r"[A-Za-z0-9]"), re.compile(r"[0-9]"), re.compile(r"[0-9]"), re.compile(r"[0-9(+]"))
LAST = (re.compile(r"[A-Za-z0-9]"), re.compile(r"[0-9]"), re.compile(r"[0-9]"), re.compile(r"[0-9]"))
FULL = (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"), re.compile(r"[0-9]+(\.[0-9]+)+"),
        re.compile(r"[0-9][0-9 .-]{10,}[0-9]"), re.compile(r"[+(]?[0-9][0-9 ().-]{5,}[0-9]"))


def passes(kind: int, span: str) -> bool:
    """The checks of the patterns, on a span of the field: an address has four parts
    up to 255, a card 14 to 19 digits passing Luhn, a phone up to 15 digits."""
    digits = [int(x) for x in span if x in "0123456789"]
    if kind == 1:
        parts = span.split(".")
        return len(parts) == 4 and all(len(x) <= 255 and int(x) <= 255 for x in parts)
    if kind == 2:
        twice = [x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind == 0 or len(digits) <= 15


def added(w: Words, labels: np.ndarray, texts: list[str | None], base: list[list]) -> list[list[tuple[int, int, int]]]:
    """The decoded entities of each text that overlap no pattern span."""
    out: list[list] = [[] for _ in texts]
    i, n = 0, len(labels)
    while i < n:
        if labels[i] == 0:
            i += 1
            continue
        k, j, d = (int(labels[i]) - 1) // 2, i + 1, int(w.doc[i])
        while j < n and labels[j] == 2 + 2 * k and w.doc[j] == d:
            j += 1
        s, e = int(w.start[i]), int(w.end[j - 1])
        i = j
        text = texts[d]
        while s < e and not OWN[k].match(text[s]):
            s += 1
        while s < e and not LAST[k].match(text[e - 1]):
            e -= 1
        if s < e and FULL[k].fullmatch(text, s, e) and passes(k, text[s:e]) and not any(a < e and s < b for a, b, _ in base[d]):
            out[d].append((s, e, k))
    return out


ADDED = [*((f"n_{k}", "bigint") for k in KINDS), ("base_sha256", "string"), ("spans", "string"), ("redacted", "string")]


def detect(docs: DataFrame, field: Field | None, p: Params = Params(), text: str = "text",
           redact: bool = False) -> DataFrame:
    """docs with the pattern counts, the digest of the pattern spans and all
    spans; with ``redact`` also the text with each span replaced by its kind."""
    names = [n for n, _ in ADDED[: len(ADDED) if redact else -1]]
    cols = [c for c in docs.columns if c not in names]
    docs = docs.select(*[F.col(f"`{c}`") for c in cols])
    i = cols.index(text)
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(i)
            counts = np.zeros((b.num_rows, len(KINDS)), np.int64)
            sha, spans, clean = [nothing] * b.num_rows, [""] * b.num_rows, col.to_pylist() if redact else None
            for lo, hi, data, offs in K.chunks(col):
                cue = np.diff(np.concatenate([[0], np.cumsum(CUE[data])])[offs]) > 0
                rows = np.flatnonzero(cue)
                if len(rows) == 0:
                    continue
                some = col.slice(lo, hi - lo).take(pa.array(rows))
                texts = some.to_pylist()
                base = [pattern_spans(t) for t in texts]
                more: list[list] = [[] for _ in texts]
                if field is not None:
                    for lo2, hi2, data2, offs2 in K.chunks(some):
                        w = cue_words(data2, offs2, p.bits)
                        more[lo2:hi2] = added(w, field.decode(w), texts[lo2:hi2], base[lo2:hi2])
                for r, t, found, extra in zip(rows, texts, base, more, strict=True):
                    at = lo + int(r)
                    for _, _, k in found:
                        counts[at, k] += 1
                    sha[at] = hashlib.sha256(render(found).encode()).hexdigest()
                    spans[at] = render(found + extra)
                    if redact:
                        clean[at] = mask(t, found + extra)
            more_cols = [*(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(sha, pa.string()),
                         pa.array(spans, pa.string())]
            if redact:
                more_cols.append(pa.array(clean, pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, *more_cols], names=[*b.schema.names, *names])

    kinds = dict(ADDED)
    like = docs.limit(0).select("*", *[F.lit(None).cast(kinds[n]).alias(n) for n in names])
    return docs.mapInArrow(run, like.schema)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones as one, named by the first)
    replaced by its kind in angle brackets."""
    out, at, last = [], 0, -1
    for s, e, k in sorted(spans, key=lambda x: (x[0], x[2])):
        if s >= at or last < 0:
            out += [text[max(at, 0):s], f"<{KINDS[k].upper()}>"]
            at = e
        at, last = max(at, e), k
    return "".join([*out, text[at:]])


def op10(docs: DataFrame, p: Params = Params()) -> DataFrame:
    out = detect(docs.select("doc_id", "text"), train(docs.select("text"), p), p)
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans")
