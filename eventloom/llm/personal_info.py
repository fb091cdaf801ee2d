"""Personal data inside the free text of events: found, and replaced by typed placeholders."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.crf import JOINT, KINDS, LABELS, OFFSETS, REACH, TOKEN, Tagger, certainly_outside, number_shape, viterbi

FIELDS = ("text", "output", "error", "command", "args")
#: Kinds of pieces whose scores a Python worker keeps.
KEPT_TYPES = 100_000


def labelled_examples(path: str | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The labelled table: texts with the spans of their pieces of personal data."""
    path = path or str(Path(__file__).with_name("personal_info_labels.txt"))
    out = []
    with open(path, encoding="utf-8") as f:
        for line in f:
            if line.startswith("#"):
                continue
            line, text, spans, at = line.rstrip("\n").replace("\\n", "\n").replace("\\t", "\t"), "", [], 0
            for m in regex.finditer(r"\[\[(\w+)\|(.*?)\]\]", line):
                text += line[at : m.start()]
                spans.append((len(text), len(text) + len(m[2]), m[1]))
                text, at = text + m[2], m.end()
            out.append((text + line[at:], spans))
    return out


@lru_cache(maxsize=4)
def trained_tagger(path: str | None = None) -> Tagger:
    """The tagger fitted to the labelled table, once in a process."""
    return Tagger().fit(labelled_examples(path))


class _Types:
    """The scores of the pieces that a worker has met."""

    def __init__(self, tagger: Tagger):
        self.tagger = tagger
        self.clear()

    def clear(self):
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1, len(OFFSETS) * len(LABELS)), np.float32)
        self.classes = np.zeros(1, np.int64)

    def of(self, types: list[str]) -> np.ndarray:
        """The row of each piece; row 0 is no piece."""
        if len(self.rows) > KEPT_TYPES:
            self.clear()
        new = [t for t in types if t not in self.rows]
        if new:
            scores, classes = self.tagger.table(new)
            base = len(self.classes)
            self.rows.update({t: base + i for i, t in enumerate(new)})
            self.scores, self.classes = np.concatenate([self.scores, scores]), np.concatenate([self.classes, classes])
        return np.array([self.rows[t] for t in types], np.int64)


def found_spans(tokens: pa.Array, types: _Types) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Spans of personal data in texts given as pieces: first and end piece, kind; then the piece strings and codes."""
    coded = tokens.flatten().dictionary_encode()
    strings, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    low, high = np.repeat(ends - lengths, lengths), np.repeat(ends, lengths)
    if not len(codes):
        return codes, codes, codes, strings, codes
    rows, every = types.of(strings)[codes], np.arange(len(codes))
    around = {}
    for o in range(-REACH, REACH + 1):
        there = every + o
        around[o] = np.where((there >= low) & (there < high), rows[np.clip(there, 0, len(rows) - 1)], 0)
    n = len(LABELS)
    scores = np.zeros((len(codes), n), np.float32)
    for k, o in enumerate(OFFSETS):
        scores += types.scores[around[o], k * n : (k + 1) * n]
    joint = types.tagger.joint({o: types.classes[r] for o, r in around.items()})
    for k in range(len(JOINT)):
        scores += types.tagger.shared[joint[:, k]]
    at = np.flatnonzero(~certainly_outside(scores, every == high - 1, types.tagger.moves))
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (low[at][1:] != low[at][:-1])])) if len(at) else at
    labels = viterbi(scores[at], starts, np.diff(np.append(starts, len(at))), types.tagger.moves)
    begins = np.flatnonzero(labels % 2 == 1)
    further = (labels > 0) & (labels % 2 == 0)
    stops = np.flatnonzero(np.append(~further, True))
    until = stops[np.searchsorted(stops, begins + 1)]
    out = []
    piece = lambda i: strings[codes[i]]
    for a, b, k in zip(at[begins].tolist(), (at[until - 1] + 1).tolist(), ((labels[begins] - 1) // 2).tolist(), strict=True):
        span = _mended(KINDS[k], a, b, int(low[a]), int(high[a]), piece, types.tagger.words)
        if span and (not out or span[0] >= out[-1][1]):
            out.append((*span, k))
    first, end, kind = np.array(out, np.int64).reshape(-1, 3).T
    return first, end, kind, strings, codes


#: Abbreviations that keep their full stop at the end of an address.
_ABBREVIATED = frozenset(("st", "str"))
_JOINTS = frozenset("-./\u2010\u2011")
_HYPHENS = frozenset("-\u2010\u2011")
#: Marks that the local part of an email may have between its letters and digits.
_LOCAL = frozenset(".-_+%'")
#: What stands for the sign of an email; the numbers follow a percent sign and ``\\u``.
_AT = frozenset(("@", "\uff20", "at", "40", "0040"))


def _whole_number(a: int, b: int, low: int, high: int, piece, shapes: frozenset) -> tuple[int, int] | None:
    """The longest span near a tagged one that has the shape of a labelled number and is no part of a longer code."""
    joined = lambda i: low < i < high and piece(i) == piece(i).lstrip()  # noqa: E731  no blank before it
    best = None
    for start in range(max(low, a - 3), min(a + 4, high)):
        before = piece(start - 1) if joined(start) else ""
        if before[-1:].isalnum() or (before in _HYPHENS and joined(start - 1) and piece(start - 2)[-1:].isalnum()):
            continue
        for end in range(max(start + 1, b - 4), min(b + 7, high) + 1):
            after = piece(end) if joined(end) else ""
            if after[:1].isalnum() or (after in _JOINTS and joined(end + 1) and piece(end + 1)[:1].isdigit()):
                continue
            text = "".join(piece(i) for i in range(start, end)).strip()
            if number_shape(text) in shapes and (best is None or end - start > best[1] - best[0]) and start < b and end > a:
                best = (start, end)
    return best


def _new_number(kind: str, a: int, b: int, low: int, high: int, piece) -> tuple[int, int] | None:
    """A tagged number of a shape that no label has, with all that is joined to it; None if it cannot be one: a phone
    number has 7 to 15 digits, an identity number 7 to 18 letters and digits, more than half of them digits or all in
    capitals, and nothing but marks between them."""
    joined = lambda i: low < i < high and piece(i) == piece(i).lstrip()
    part = lambda i: piece(i).strip()[:1].isalnum()
    while joined(a) and (part(a - 1) or (piece(a - 1).strip() in _JOINTS and joined(a - 1) and part(a - 2))):
        a -= 1
    while joined(b) and (part(b) or (piece(b) in _JOINTS and joined(b + 1) and part(b + 1))):
        b += 1
    while a < b and not (part(a) or (kind == "phone" and piece(a).strip() in "+(")):
        a += 1
    while a < b and not part(b - 1):
        b -= 1
    text = unicodedata.normalize("NFKC", "".join(piece(i) for i in range(a, b)).strip())
    letters, digits = sum(c.isalpha() for c in text), sum(c.isdigit() for c in text)
    if any(not c.isalnum() and c not in " +()-./\u2010\u2011" for c in text):
        return None
    if kind == "phone":
        return (a, b) if not letters and 7 <= digits <= 15 else None
    return (a, b) if 7 <= letters + digits <= 18 and digits >= 5 and (digits > letters or text.upper() == text) else None


def _local(text: str) -> bool:
    return bool(text) and (text.isalnum() or unicodedata.category(text[0]) in ("Mn", "Mc") or text in _LOCAL)


def _mended(kind: str, a: int, b: int, low: int, high: int, piece, words: dict) -> tuple[int, int] | None:
    """Move the ends of a tagged span to where such a piece can end; None if it can be none. ``piece`` gives the string
    at a place. A number takes the shape of a labelled one if one fits; an email takes all that is joined to it on the
    left of its sign and a joined domain, and has a sign; a name has two words without digits; an address has a number and keeps the stop of an abbreviation only; nothing
    crosses a line or a tab."""
    if kind in ("phone", "id_number"):
        return _whole_number(a, b, low, high, piece, words[f"shapes_{kind}"]) or _new_number(kind, a, b, low, high, piece)
    joined = lambda i: low < i < high and piece(i) == piece(i).lstrip()
    if kind == "email":
        while joined(a) and _local(piece(a - 1).strip()) and not (piece(a - 1).strip() in _LOCAL and not (joined(a - 1) and _local(piece(a - 2).strip()))):
            a -= 1
        if piece(b - 1) == "." and joined(b) and piece(b).isalpha():
            b += 1
        while joined(b) and joined(b + 1) and piece(b) in ".-" and piece(b + 1).isalnum():
            b += 2
        return (a, b) if any(piece(i).strip().lower() in _AT for i in range(a, b)) else None
    for i in range(a + 1, b):
        if piece(i)[:1] in "\t\n\r":
            if kind == "name":
                b = i
                break
            a = i
    while a < b and not piece(a).strip()[:1].isalnum():
        a += 1
    if kind == "address" and b > a:
        if a > low and piece(a).strip().isalpha() and piece(a - 1).strip().isdigit() and "\n" not in piece(a):
            a -= 1
        if b < high and piece(b - 1).strip() == "," and piece(b).strip().isdigit():
            b += 1
        short = lambda i: piece(i).strip().lower() in _ABBREVIATED or piece(i).lower().endswith("str")
        while b > a and (piece(b - 1).strip() in (",", ";", ":", "") or (piece(b - 1) == "." and not short(b - 2))):
            b -= 1
        if joined(b) and piece(b) == "." and short(b - 1):
            b += 1
        if not any(piece(i).strip().isdigit() for i in range(a, b)):
            return None
    if kind == "name":
        words = [w for i in range(a, b) if (w := piece(i).strip())[:1].isalnum()]
        if len(words) < 2 or max(map(len, words)) < 2 or not all(w.isalpha() or unicodedata.category(w[-1]) == "Mn" for w in words):
            return None
    return (a, b) if b > a else None


def _tagger_of(spark, labels: str | None):
    return spark.sparkContext.broadcast(trained_tagger(labels))


_WORKER: dict[int, _Types] = {}


def _types(sent) -> _Types:
    """The worker's scores for the broadcast tagger."""
    key = id(sent.value)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = _Types(sent.value)
    return _WORKER[key]


def personal_info(events: DataFrame, labels: str | None = None) -> DataFrame:
    """The pieces of personal data in the payload of events: ``(delivery_seq, field, kind, found_text)``.

    A linear-chain conditional random field over the shapes of pieces of text, fitted to a small labelled table, tags
    them; the best labels are found by Viterbi in numpy batches. Texts are split in the JVM, whole; a piece's own features
    are scored once for each different piece of a batch, and every piece is scored in its place and decoded, but for those
    that are proved to lie outside (``crf.certainly_outside``). No list of words or shapes decides what is decoded; given
    names and beginnings and ends of family names in the labels are features among others. Nothing is shuffled, so no row
    is hot.

    ``found_text`` is the piece as it stands in the text. A piece that a field repeats counts once. Nulls: a null
    payload, field or ``delivery_seq`` gives no row. Repeated rows come out as often. An empty table gives no rows.
    Very long texts are tagged as a whole. Extra columns are ignored.
    """
    sent = _tagger_of(events.sparkSession, labels)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            first, end, kind, strings, codes = found_spans(tokens, _types(sent))
            lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            row = np.searchsorted(np.cumsum(lengths), first, "right")
            texts = ["".join(strings[c] for c in codes[a:b]).strip() for a, b in zip(first, end, strict=True)]
            seen = dict.fromkeys(zip(row.tolist(), kind.tolist(), texts, strict=True))
            rows = pa.array([r for r, _, _ in seen], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("delivery_seq").take(rows), batch.column("field").take(rows),
                 pa.array([KINDS[k] for _, k, _ in seen], pa.string()), pa.array([t for _, _, t in seen], pa.string())],
                ["delivery_seq", "field", "kind", "found_text"],
            )

    fields = F.explode(F.array(*[F.struct(F.lit(x).alias("field"), F.col(f"payload.{x}").alias("text")) for x in FIELDS])).alias("f")
    split = events.where("delivery_seq IS NOT NULL").select("delivery_seq", fields).where("f.text <> ''")
    pieces = split.select("delivery_seq", "f.field", F.regexp_extract_all("f.text", F.lit(TOKEN), F.lit(0)).alias("tokens"))
    return pieces.mapInArrow(tag, "delivery_seq bigint, field string, kind string, found_text string")


def redacted(events: DataFrame, labels: str | None = None) -> DataFrame:
    """The free-text fields of every event with placeholders such as ``[EMAIL]`` for personal data, all else unchanged:
    ``(delivery_seq, text, output, error, command, args)``. Null fields stay null; see ``personal_info``."""
    sent = _tagger_of(events.sparkSession, labels)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [batch.column("delivery_seq")]
            for name in FIELDS:
                tokens = batch.column(f"{name}_tokens")
                first, end, kind, strings, codes = found_spans(tokens, _types(sent))
                lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
                ends = np.cumsum(lengths)
                row = np.searchsorted(ends, first, "right")
                texts = batch.column(name).to_pylist() if len(row) else batch.column(name)
                some, begins = np.unique(row, return_index=True)
                for r, i, j in zip(some, begins, np.searchsorted(row, some, "right"), strict=True):
                    parts, at = [], ends[r] - lengths[r]
                    for a, b, k in zip(first[i:j], end[i:j], kind[i:j], strict=True):
                        lead = strings[codes[a]]
                        parts += [strings[c] for c in codes[at:a]] + [lead[: len(lead) - len(lead.lstrip())], f"[{KINDS[k].upper()}]"]
                        at = b
                    texts[r] = "".join(parts + [strings[c] for c in codes[at : ends[r]]])
                out.append(pa.array(texts, pa.string()) if len(row) else texts)
            yield pa.RecordBatch.from_arrays(out, ["delivery_seq", *FIELDS])

    split = events.select(
        "delivery_seq", *[F.col(f"payload.{x}").alias(x) for x in FIELDS],
        *[F.regexp_extract_all(f"payload.{x}", F.lit(TOKEN), F.lit(0)).alias(f"{x}_tokens") for x in FIELDS],
    )
    return split.mapInArrow(replace, "delivery_seq bigint, " + ", ".join(f"{x} string" for x in FIELDS))
