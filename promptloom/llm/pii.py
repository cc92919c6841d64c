"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

The patterns (email, ip, card, phone) are found in linear time and always stay.  Beside them a
linear-chain CRF labels the tokens of a line from word-shape features: the shapes of the token and
of its neighbours, and a few telling words.  It is trained on the small labelled table
``examples()`` and decoded by Viterbi, many lines at a time, in numpy.  A run of one label becomes
a span if it does not overlap a pattern's span and holds what its kind must hold (``plausible``),
such as an address written out in words or a phone number without its plus.

Every plausible span holds a digit, an ``@``, the word ``dot`` or a bracketed ``at``, and is at most
``LONGEST`` characters long.  So each line is decoded in stretches that reach ``CONTEXT`` characters
around every such mark, overlapping ones as one; what lies further off can give no span whatever
its labels.  A stretch longer than ``STRETCH`` is decoded in parts that overlap by the same context,
so memory does not depend on how long a line is.

Defined results: null and empty texts hold nothing; ids pass through, null and repeated ones too,
one row per input row; an empty table gives an empty result; other columns are ignored.  Positions
are code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from promptloom.llm.lean import lean

KINDS = ("email", "ip", "card", "phone")
NONE = "none"
LABELS = (NONE, *KINDS)

# ---------------------------------------------------------------- patterns

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
# a match can only begin at the head of a run of digits, which keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            done = domain.end()
            found.append(("email", begin, done))
        else:
            done = max(done, at + 1)  # no match can begin before an @ that gave none
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, by kind and start."""
    found = _emails(text)
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


# ---------------------------------------------------------------- the labelled table

#: Bracketed parts carry their label; addresses are of reserved ranges and domains.
_MARKED = [
    "write to [email:anna dot berg at example dot com] today", "mail me : [email:j.smith at mail dot example dot org] .",
    "contact [email:peter (at) example (dot) net] for more", "reach [email:info [at] shop [dot] com] or wait",
    "his address is [email:tom _ b at home dot net] , she said", "send it to [email:kim at uni dot edu] and go",
    "email [email:office (at) firm.com] now", "The list is at [email:news AT post DOT org] .",
    "call ([phone:212) 555-0147] now", "phone [phone:212-555-0147] or come", "tel : [phone:(415) 555 0132] .", "Tel. [phone:020 7946 0958] , ask",
    "ring [phone:555-867-5309] after six", "her phone number is [phone:(651) 555-8500] there", "fax [phone:030 / 901820 55] please",
    "call me at [phone:917.555.0191] tonight", "mobile [phone:0170 555 12 34] only", "phone : [phone:1-800-555-0199]",
    "host [ip:192 . 168 . 0 . 12] is down", "ping [ip:10 . 0 . 0 . 1] first", "address [ip:172 . 16 . 254 . 3] , port",
    "card [card:4111.1111.1111.1111] was used", "card number [card:5500/0000/0000/0004] expires", "visa [card:4012_8888_8888_1881] ok",
]
#: Nothing of these is personal data.
_CLEAN = [
    "the meeting is at 10 am on 12 . 05 . 2021 in room 4", "they met at the house and at the lake", "a dot at the end of the line",
    "version 2 . 0 of the plan", "in 1999 and 2004 there were 35 of them", "it cost 1,250.00 in 2010", "see page 12 - 15 , lines 3 to 9",
    "the ratio was 3 . 14 to 1", "token = \" 5d1e2f3a4b5c6d7e8f9a0b1c2d3e4f5a6b7c8d9e \"", "order 4711 shipped on 2020-03-04 at 11:30",
    "4508665317339 was the number", "4844508665317339 is not valid", "1 2 3 4 5 6 7", "chapter 5 . 2 . 1 . 3 of the book", "one dot and two dots",
    "look at the dot com boom", "he was at the door . Then he left", "The team won 3 - 2 , then 4 - 1 .", "call him at home or at work",
    "she will call at noon", "phone calls are free", "email is fast", "the card was red", "the host spoke at length", "a number of people came",
    "(see 12) and (13)", "id 00998877 and id 12345678901", "# 12 @ 3 % + 4", "@ home", "x @ y", "a@b", "50 % of 200 + 3", "it is 5 pm - 6 pm",
    "Lorem ipsum dolor sit amet , consetetur ( sadipscing ) elitr .", "word ; word : word ! word ? \" word \" ' word ' - word / word",
    "AND THEN ALL WENT HOME !! YES !!", "one | two | three", "a *** b &&& c %%% d $$$ e ### f", "ein Über äußerst schönes Österreich",
    "Été à la forêt , où ça ?", "El niño está aquí . ¿ Qué ?", "CamelCase and iPhone and eBay", "thon edat ( ertion ) , inly ; her : or . and",
]


def examples() -> list[tuple[str, list[Span]]]:
    """The labelled table: a line and its spans."""
    rows: list[tuple[str, list[Span]]] = []
    for line in _MARKED:
        text, spans = "", []
        for part in re.split(r"(\[(?:email|ip|card|phone):(?:[^\[\]]|\[(?:at|dot)\])*\])", line):
            kind, _, body = part[1:-1].partition(":") if part.startswith("[") else ("", "", "")
            if kind in KINDS:
                spans.append((kind, len(text), len(text) + len(body)))
                text += body
            else:
                text += part
        rows.append((text, spans))
    return rows + [(line, []) for line in _CLEAN]


# ---------------------------------------------------------------- features

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_|\S")
#: Words that tell of a kind.
_TELLING = frozenset("at dot com org net edu mail email phone tel call fax mobile ring card visa host ip ping number address".split())
#: Every plausible span holds one of these.
_RARE = re.compile(r"[0-9@]|\bdot\b|[(\[]at[)\]]", re.IGNORECASE)


def shape(token: str) -> str:
    c = token[0]
    if "0" <= c <= "9":
        return "9" * len(token) if len(token) <= 5 else "9+" if len(token) < 12 else "9++"
    if c.isalpha():
        word = token.lower()
        if word == "dot":
            return "<dot>"
        return "x" if token.islower() else "X" if token.isupper() else "Xx" if token[1:].islower() else "xX"
    return c if c in ".,:;!?()[]{}<>@+-_/\\%&$#*|=\"'" else "?"


def _named(token: str) -> str:
    word = token.lower()
    return word if word in _TELLING else ""


def features(tokens: list[str]) -> list[list[str]]:
    """The feature names of each token."""
    s = ["<<", "<", *map(shape, tokens), ">", ">>"]
    w = ["", "", *map(_named, tokens), "", ""]
    out = []
    for k in range(2, len(s) - 2):
        own = [
            f"0{s[k]}", f"-{s[k - 1]}", f"+{s[k + 1]}", f"-0{s[k - 1]} {s[k]}", f"0+{s[k]} {s[k + 1]}", f"-0+{s[k - 1]} {s[k]} {s[k + 1]}",
            f"--{s[k - 2]} {s[k - 1]} {s[k]}", f"++{s[k]} {s[k + 1]} {s[k + 2]}",
        ]
        own += [f"{p}={w[k + d]}" for p, d in (("w0", 0), ("w-", -1), ("w+", 1)) if w[k + d]]
        out.append(own)
    return out


# ---------------------------------------------------------------- the field


@dataclass(frozen=True)
class Field:
    names: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray
    begin: np.ndarray

    def emissions(self, tokens: list[str]) -> np.ndarray:
        get, rows = self.names.get, self.weights
        return np.array([rows[[n for n in map(get, f) if n is not None]].sum(axis=0) for f in features(tokens)])


def _pad(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in sequences])
    out = np.zeros((len(sequences), sizes.max(), len(LABELS)))
    for k, s in enumerate(sequences):
        out[k, : len(s)] = s
    return out, sizes


def viterbi(field: Field, sequences: list[np.ndarray]) -> list[np.ndarray]:
    """The best labels of each sequence of emissions, all sequences side by side."""
    scores, sizes = _pad(sequences)
    n, longest, _ = scores.shape
    best = scores[:, 0] + field.begin
    back = np.zeros((n, longest, len(LABELS)), np.int8)
    for t in range(1, longest):
        through = best[:, :, None] + field.steps[None]
        back[:, t] = through.argmax(axis=1)
        best = np.where((t < sizes)[:, None], through.max(axis=1) + scores[:, t], best)
    labels = np.zeros((n, longest), np.int8)
    rows = np.arange(n)
    labels[rows, sizes - 1] = best.argmax(axis=1)
    for t in range(longest - 1, 0, -1):
        previous = back[rows, t, labels[:, t]]
        labels[:, t - 1] = np.where(t < sizes, previous, labels[:, t - 1])
    return [labels[k, :size] for k, size in enumerate(sizes)]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(rounds: int = 150, rate: float = 0.15, decay: float = 0.01) -> Field:
    """Maximum likelihood by Adam; gradients from the forward-backward sums."""
    k = len(LABELS)
    lines = []
    for text, spans in examples():
        marks = list(_TOKEN.finditer(text))
        gold = [next((LABELS.index(s[0]) for s in spans if s[1] <= m.start() < s[2]), 0) for m in marks]
        lines.append((features([m[0] for m in marks]), gold))
    names = {f: n for n, f in enumerate(sorted({f for line, _ in lines for token in line for f in token}))}
    sizes = np.array([len(g) for _, g in lines])
    n, longest = len(lines), int(sizes.max())
    rows, cols = zip(*[(r * longest + t, names[f]) for r, (line, _) in enumerate(lines) for t, token in enumerate(line) for f in token], strict=True)
    x = np.zeros((n * longest, len(names)))
    x[list(rows), list(cols)] = 1
    gold = np.zeros((n, longest), int)
    for r, (_, g) in enumerate(lines):
        gold[r, : len(g)] = g
    inside = np.arange(longest)[None] < sizes[:, None]
    truth = np.eye(k)[gold] * inside[:, :, None]
    pairs = inside[:, 1:]
    seen_steps = np.einsum("rti,rtj->ij", truth[:, :-1] * pairs[:, :, None], truth[:, 1:])
    p = [np.zeros((len(names), k)), np.zeros((k, k)), np.zeros(k)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for turn in range(1, rounds + 1):
        scores = (x @ p[0]).reshape(n, longest, k)
        ahead, behind = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        ahead[:, 0] = scores[:, 0] + p[2]
        for t in range(1, longest):
            moved = _logsum(ahead[:, t - 1, :, None] + p[1][None], 1) + scores[:, t]
            ahead[:, t] = np.where(inside[:, t, None], moved, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            moved = _logsum(p[1][None] + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(inside[:, t + 1, None], moved, 0)
        total = _logsum(ahead[:, -1], 1)
        share = np.exp(ahead + behind - total[:, None, None]) * inside[:, :, None]
        both = ahead[:, :-1, :, None] + p[1] + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        both = np.exp(np.minimum(both, 0)) * pairs[:, :, None, None]
        grads = [
            x.T @ (share - truth).reshape(n * longest, k) + decay * p[0] * n,
            both.sum(axis=(0, 1)) - seen_steps + decay * p[1] * n,
            share[:, 0].sum(axis=0) - truth[:, 0].sum(axis=0) + decay * p[2] * n,
        ]
        for q, g in enumerate(grads):
            m[q] = 0.9 * m[q] + 0.1 * g
            v[q] = 0.999 * v[q] + 0.001 * g * g
            p[q] = p[q] - rate * (m[q] / (1 - 0.9**turn)) / (np.sqrt(v[q] / (1 - 0.999**turn)) + 1e-8)
    return Field(names, *p)


def plausible(kind: str, text: str) -> bool:
    """What a span of the kind must hold at least."""
    digits = _digits(text)
    if kind == "phone":
        return 8 <= len(digits) <= 15 and not luhn_card(digits)
    if kind == "card":
        return luhn_card(digits)
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    words = [w.lower() for w in re.findall(r"[^\W_]+", text)]
    parted = ("at" in words[1:] or "@" in text) and ("dot" in words or "." in text) and len(words) >= 4
    return parted and ("@" in text or "dot" in words or bool(re.search(r"[(\[]at[)\]]", text, re.IGNORECASE)))


def luhn_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


#: Characters of a plausible span, of context around a mark, and of a stretch decoded at once.
LONGEST, CONTEXT, STRETCH = 200, 400, 20_000
#: Tokens decoded together.
_TOGETHER = 50_000


def stretches(text: str) -> list[tuple[int, int, int, int]]:
    """(begin, end, first, last): decode text[begin:end], keep spans that begin in first to last."""
    merged: list[list[int]] = []
    line_end = -1
    for mark in _RARE.finditer(text):
        if mark.start() >= line_end:  # the first mark of a line
            line_begin = text.rfind("\n", 0, mark.start()) + 1
            line_end = text.find("\n", mark.start())
            line_end = len(text) if line_end < 0 else line_end
        begin, end = max(line_begin, mark.start() - CONTEXT), min(line_end, mark.end() + CONTEXT)
        if merged and begin <= merged[-1][1] and merged[-1][0] >= line_begin:
            merged[-1][1] = end
        else:
            merged.append([begin, end])
    out = []
    for begin, end in merged:
        for first in range(begin, end, STRETCH):
            last = min(first + STRETCH, end)
            out.append((max(begin, first - CONTEXT), min(end, last + CONTEXT), first, last))
    return out


def found_spans(field: Field, texts: list[str], known: list[list[Span]]) -> list[list[Span]]:
    """The field's spans of each text that do not overlap the known ones."""
    out: list[list[Span]] = [[] for _ in texts]
    waiting: list[tuple[int, list[tuple[int, int]], np.ndarray, int, int]] = []
    held = 0

    def flush() -> None:
        waiting.sort(key=lambda w: len(w[1]))
        begin = 0
        while begin < len(waiting):
            end = begin + 1  # sequences of similar length share a batch
            while end < len(waiting) and len(waiting[end][1]) <= 2 * len(waiting[begin][1]) + 8 and end - begin < 512:
                end += 1
            batch = waiting[begin:end]
            for (row, marks, _, first, last), labels in zip(batch, viterbi(field, [w[2] for w in batch]), strict=True):
                place = 0
                for label, run in groupby(labels):
                    size = len(list(run))
                    if label:
                        kind, a, b = LABELS[label], marks[place][0], marks[place + size - 1][1]
                        clear = all(b <= s[1] or s[2] <= a for s in known[row])
                        if first <= a < last and b - a <= LONGEST and clear and plausible(kind, texts[row][a:b]):
                            out[row].append((kind, a, b))
                    place += size
            begin = end
        waiting.clear()

    for row, text in enumerate(texts):
        for begin, end, first, last in stretches(text):
            marks = [m.span() for m in _TOKEN.finditer(text, begin, end)]
            waiting.append((row, marks, field.emissions([text[a:b] for a, b in marks]), first, last))
            held += len(marks)
            if held > _TOGETHER:
                flush()
                held = 0
    flush()
    return out


def _order(span: Span) -> tuple:
    return KINDS.index(span[0]), span[1], span[2]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=_order))


def _rows(shipped, redact: bool):
    def run(batches):
        field = shipped.value
        for batch in batches:
            ids, column = batch.columns
            texts = [t or "" for t in column.to_pylist()]
            base = [base_spans(t) for t in texts]
            extra = found_spans(field, texts, base)
            if redact:
                clean = [None if c is None else _redacted(t, b + e) for c, t, b, e in zip(column.to_pylist(), texts, base, extra, strict=True)]
                yield pa.record_batch([ids, pa.array(clean, pa.string())], names=["id", "text"])
                continue
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            digests = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], pa.string())
            spans = pa.array([_joined(b + e) for b, e in zip(base, extra, strict=True)], pa.string())
            yield pa.record_batch([ids, *counts, digests, spans], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def _redacted(text: str, spans: list[Span]) -> str:
    """Spans give way to their kind in brackets; where spans overlap, the earliest one goes on."""
    if not spans:
        return text
    out, done = [], 0
    for kind, begin, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if begin >= done:
            out += [text[done:begin], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


def _narrow(docs: DataFrame, id_column: Column, text_column: str) -> DataFrame:
    return docs.select(id_column.alias("id"), F.col(text_column).cast("string").alias("text"))


def personal_data(docs: DataFrame, field: Field | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, the patterns' counts and digest, and all spans."""
    shipped = docs.sparkSession.sparkContext.broadcast(field or fit())
    narrow = _narrow(docs, F.col(id_column), text_column)
    fields = [StructField("id", narrow.schema["id"].dataType), *(StructField(f"n_{k}", LongType()) for k in KINDS)]
    fields += [StructField("base_sha256", StringType()), StructField("spans", StringType())]
    return narrow.mapInArrow(lean(_rows(shipped, redact=False), text=1), StructType(fields)).withColumnRenamed("id", id_column)


def redact(docs: DataFrame, field: Field | None = None, *, text_column: str = "text") -> DataFrame:
    """All rows and columns, with personal data in the text replaced by its kind; null stays null."""
    shipped = docs.sparkSession.sparkContext.broadcast(field or fit())
    others = [c for c in docs.columns if c != text_column]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(0)
    packed = docs.select(rest.alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    schema = StructType([StructField("id", packed.schema["id"].dataType), StructField("text", StringType())])
    done = packed.mapInArrow(lean(_rows(shipped, redact=True), text=1), schema)
    return done.select(*[F.col("text").alias(c) if c == text_column else F.col(f"id.`{c}`").alias(c) for c in docs.columns])
