"""A linear-chain conditional random field over hashed word-shape features, in numpy."""

from __future__ import annotations

import unicodedata

import numpy as np
import regex

#: The pieces of a text, which join to it again: letters, digits or one other character, with the blanks before it.
TOKEN = r"[ \t\n\r\f\x0B]*(?:[\p{L}\p{M}]+|\p{Nd}+|[^ \t\n\r\f\x0B\p{L}\p{M}\p{Nd}])|[ \t\n\r\f\x0B]+"
_TOKEN = regex.compile(TOKEN)
_BLANKS = " \t\n\r\f\x0b"

KINDS = ("email", "phone", "id_number", "address", "name")
#: Outside, then the first and the further pieces of each kind.
LABELS = ("O", *(f"{part}-{kind}" for kind in KINDS for part in "BI"))

#: Offsets of the pieces whose own features count, and sets of offsets whose classes count together.
OFFSETS = (-2, -1, 0, 1, 2)
JOINT = ((-1, 0), (0, 1), (-1, 0, 1), (0, 1, 2), (-2, -1, 0), (-2, 0, 2), (0, 2, 4), (-4, -2, 0), (1, 2, 3), (-3, -2, -1), (2, 4, 6))
REACH = 6
JOINT_BUCKETS = 1 << 16

EPOCHS, WARM, BATCH, RATE, DECAY, SEED = 6, 2, 96, 0.08, 1e-5, 7
#: Share of labelled lines whose names, and half of the longer words around them, are learned by shape, ending and
#: surroundings alone, as those of words that no label has.
BLIND = 0.6


def pieces(text: str) -> list[str]:
    return _TOKEN.findall(text)


def _shape(core: str) -> str:
    if core.isalpha():
        if len(core) == 1:
            return "X" if core.isupper() else "x"
        return "XX" if core.isupper() else "xx" if core.islower() else "Xx" if core[1:].islower() else "xX"
    if core.isdigit():
        return f"d{min(len(core), 12)}"
    return core if core.isascii() or not core else unicodedata.category(core[0])


def learned_words(examples: list[tuple[str, list[tuple[int, int, str]]]]) -> dict[str, frozenset]:
    """What the labelled pieces teach: given names, the beginnings and ends of family names, and the shapes of numbers.

    A family name is the word that stands last in a name without comma, or first in one with it."""
    given, heads, tails = set(), set(), set()
    for text, spans in examples:
        for low, high, kind in spans:
            words = [w.lower() for w in regex.findall(r"\p{L}{2,}", text[low:high])] if kind == "name" else []
            if len(words) > 1:
                first, family = (words[-1], words[:-1]) if "," in text[low:high] else (words[0], words[1:])
                given.add(first)
                heads.update(w[:3] for w in family)
                tails.update(w[-4:] for w in family)
    shapes = {f"shapes_{kind}": frozenset(number_shape(text[a:b]) for text, spans in examples for a, b, k in spans if k == kind) for kind in KINDS}
    return {"given": frozenset(given), "heads": frozenset(heads), "tails": frozenset(tails), **shapes}


def number_shape(text: str) -> str:
    """A number with its letters as A, its digits as 0 and its hyphens alike."""
    plain = unicodedata.normalize("NFKC", text).replace("\u2010", "-").replace("\u2011", "-")
    return "".join("A" if c.isalpha() else "0" if c.isdigit() else c for c in plain)


class Tagger:
    """Tags pieces of text; ``fit`` it to labelled examples first."""

    def __init__(self):
        self.features: dict[str, int] = {}
        self.classes: dict[str, int] = {"": 0}
        self.words: dict[str, frozenset] = {}

    def describe(self, piece: str, blind: bool = False) -> tuple[list[str], str]:
        """The features of a piece by itself, and its class; a blind one shows no word that is known."""
        core = unicodedata.normalize("NFKC", piece.strip(_BLANKS))
        blank = piece[: len(piece) - len(piece.lstrip(_BLANKS))]
        gap = "" if not blank else "n" if "\n" in blank else "_"
        shape, low = _shape(core), core.lower()
        found = [f"s={shape}", f"g={gap}", f"s={shape}|{gap}"]
        if not blind:
            found += [f"w={low}", f"w={low}|{gap}"]
        known = family = False
        if core.isalpha():
            known = not blind and low in self.words["given"]
            family = not blind and len(low) > 5 and low[:3] in self.words["heads"] and low[-4:] in self.words["tails"]
            found += [f"l={min(len(low), 10)}|{shape}", f"n={known}{family}|{shape}"]
            if len(low) > 4:
                found += [f"u={low[-2:]}", f"u={low[-3:]}", f"u={low[-4:]}"] + ([] if blind else [f"p={low[:3]}", f"p={low[:4]}", f"u={low[-5:]}"])
        elif core.isdigit():
            found += [f"f={low[:1]}|{len(low)}", f"f={low[:2]}|{len(low)}", f"f={low[:3]}|{len(low)}"]
        return found, f"{shape}|{gap}|{known}{family}"

    def _ids(self, found: list[str], grow: bool) -> list[int]:
        if grow:
            return [self.features.setdefault(f, len(self.features)) for f in found]
        return [self.features[f] for f in found if f in self.features]

    def table(self, types: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each piece: its score by offset and label, and its class."""
        ids, sizes, classes = [], [], []
        for piece in types:
            found, kind = self.describe(piece)
            mine = self._ids(found, False)
            ids += mine
            sizes.append(len(mine))
            classes.append(self.classes.get(kind, 0))
        scores = np.zeros((len(types), self.own.shape[1]), np.float32)
        np.add.at(scores, np.repeat(np.arange(len(types)), sizes), self.own[ids])
        return scores, np.array(classes, np.int64)

    @staticmethod
    def joint(around: dict[int, np.ndarray]) -> np.ndarray:
        """The buckets of the joint features, from the classes at each offset."""
        out = []
        for k, offsets in enumerate(JOINT):
            h = np.full(len(around[0]), k + 1, np.uint64)
            for o in offsets:
                h = (h * np.uint64(1_000_003) + around[o].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out.append((h % np.uint64(JOINT_BUCKETS)).astype(np.int64))
        return np.stack(out, 1)

    def fit(self, examples: list[tuple[str, list[tuple[int, int, str]]]]) -> Tagger:
        """Fit to texts with labelled spans by stochastic gradients of the likelihood, averaged over the epochs after the
        first ``WARM``; the same examples give the same model. In a share ``BLIND`` of the lines names, and half of the longer words outside, do not show which word they
        are nor whether it is known, so that new words are told apart as well."""
        self.words = learned_words(examples)
        n_labels, rng, lines = len(LABELS), np.random.default_rng(SEED), []
        for text, spans in examples:
            toks, at, blind = pieces(text), 0, rng.random() < BLIND
            labels, found, classes = [], [], []
            for piece in toks:
                start = at + len(piece) - len(piece.lstrip(_BLANKS))
                at += len(piece)
                span = next((s for s in spans if s[0] <= start < s[1]), None)
                labels.append(0 if span is None else 1 + 2 * KINDS.index(span[2]) + (start > span[0]))
                hidden = blind and (span[2] == "name" if span else len(piece) > 4 and rng.random() < 0.5)
                f, kind = self.describe(piece, hidden)
                found.append(self._ids(f, True))
                classes.append(self.classes.setdefault(kind, len(self.classes)))
            if toks:
                lines.append((labels, found, classes))
        lines.sort(key=lambda x: len(x[0]))
        batches = [self._batch(lines[low : low + BATCH]) for low in range(0, len(lines), BATCH)]
        size = len(self.features) * len(OFFSETS)
        weights = np.zeros((size + JOINT_BUCKETS, n_labels), np.float32)
        moves = np.zeros((n_labels, n_labels))
        banned = np.zeros((n_labels, n_labels), bool)
        banned[:, 2::2] = True
        for k in range(1, n_labels, 2):
            banned[k, k + 1] = banned[k + 1, k + 1] = False
        for ids, *_ in batches:  # joint features come after all others
            ids[ids < 0] += size + JOINT_BUCKETS
        for b in batches:
            b.append(np.argsort(b[0], kind="stable"))
            used, starts = np.unique(b[0][b[-1]], return_index=True)
            b += [used, starts]
        squares, move_squares = np.full(len(weights), 1e-8, np.float32), np.full_like(moves, 1e-8)
        mean, mean_moves = np.zeros_like(weights), np.zeros_like(moves)
        for epoch in range(EPOCHS):
            rate = RATE / (1 + 0.3 * epoch)
            for k in rng.permutation(len(batches)):
                ids, rows, mask, truth, by_id, used, starts = batches[k]
                scores = np.zeros((*mask.shape, n_labels), np.float32)
                scores[mask] = np.add.reduceat(weights[ids], np.flatnonzero(np.diff(rows, prepend=-1)), axis=0)
                marginals, pairs = _expected(scores, mask, np.where(banned, -1e4, moves))
                marginals[np.arange(len(mask))[:, None], np.arange(mask.shape[1]), truth] -= 1
                step, inside = pairs, mask[:, 1:]
                np.subtract.at(step, (truth[:, :-1][inside], truth[:, 1:][inside]), 1)
                slope = np.add.reduceat(marginals[mask].astype(np.float32)[rows[by_id]], starts, axis=0) + np.float32(DECAY) * weights[used]
                squares[used] += (slope**2).mean(1)
                weights[used] -= np.float32(rate) * slope / np.sqrt(squares[used])[:, None]
                move_squares += step**2
                moves -= rate * step / np.sqrt(move_squares)
            if epoch >= WARM:
                mean += weights / (EPOCHS - WARM)
                mean_moves += moves / (EPOCHS - WARM)
        weights, moves = mean, mean_moves
        self.own = weights[:size].reshape(-1, len(OFFSETS) * n_labels)
        self.shared = weights[size:]
        self.moves = np.where(banned, -1e4, moves).astype(np.float32)
        return self

    def _batch(self, lines: list) -> list:
        """Feature ids (those of joint features count from below 0), the row of each, and the mask and labels of lines."""
        lengths = np.array([len(x[0]) for x in lines])
        mask = np.arange(lengths.max()) < lengths[:, None]
        truth = np.zeros(mask.shape, np.int64)
        truth[mask] = np.concatenate([x[0] for x in lines])
        sizes = np.array([len(f) for x in lines for f in x[1]])
        own = np.array([i for x in lines for f in x[1] for i in f])
        line, ends = np.repeat(np.arange(len(lines)), lengths), np.cumsum(sizes)
        ids, rows = [], []
        for k, o in enumerate(OFFSETS):
            to = np.arange(len(line))
            there = np.clip(to + o, 0, len(line) - 1)
            ok = (to + o >= 0) & (to + o < len(line)) & (line[there] == line)
            to, there = to[ok], there[ok]
            n = sizes[there]
            places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[there] - n, n)
            ids.append(own[places] * len(OFFSETS) + k)
            rows.append(np.repeat(to, n))
        pad = [0] * REACH
        classes = np.concatenate([np.concatenate([pad, x[2], pad]) for x in lines]).astype(np.int64)
        at = np.flatnonzero(np.concatenate([np.concatenate([pad, np.ones(len(x[2])), pad]) for x in lines]))
        joint = self.joint({o: classes[at + o] for o in range(-REACH, REACH + 1)})
        ids.append((joint - JOINT_BUCKETS).ravel())
        rows.append(np.repeat(np.arange(len(line)), len(JOINT)))
        ids, rows = np.concatenate(ids), np.concatenate(rows)
        order = np.argsort(rows, kind="stable")
        return [ids[order], rows[order], mask, truth]


def _expected(scores: np.ndarray, mask: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals and summed transition marginals, by the forward and backward recursions in scaled form."""
    n, longest, labels = scores.shape
    e = np.exp(scores - scores.max(2, keepdims=True))
    m = np.exp(moves)
    forward, backward = np.zeros_like(e), np.ones_like(e)
    start = np.ones(labels)
    start[2::2] = 0
    forward[:, 0] = e[:, 0] * start
    forward[:, 0] /= forward[:, 0].sum(1, keepdims=True)
    for t in range(1, longest):
        f = (forward[:, t - 1] @ m) * e[:, t]
        f /= f.sum(1, keepdims=True)
        forward[:, t] = np.where(mask[:, t, None], f, forward[:, t - 1])
    pairs = np.zeros((labels, labels))
    for t in range(longest - 2, -1, -1):
        b = (e[:, t + 1] * backward[:, t + 1]) @ m.T
        b /= b.sum(1, keepdims=True)
        live = mask[:, t + 1]
        backward[:, t] = np.where(live[:, None], b, 1.0)
        if live.any():
            p = forward[live, t][:, :, None] * m * (e[live, t + 1] * backward[live, t + 1])[:, None, :]
            pairs += (p / p.sum((1, 2), keepdims=True)).sum(0)
    marginals = forward * backward
    return marginals / marginals.sum(2, keepdims=True), pairs


def certainly_outside(scores: np.ndarray, last: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The pieces that the best path labels as outside whatever stands around; ``last`` marks the ends of texts.

    Proof: let the best path have a label k but outside at t. Put outside there, and begin the piece that goes on after it
    anew. What is gained is the difference of the scores at t, and at t + 1 that of beginning and going on, and at least
    the least change over all moves before and after. Where that is above 0 for each k, no best path has it.
    """
    following = np.zeros_like(scores[:, 1::2])
    following[:-1] = scores[1:, 1::2] - scores[1:, 2::2]
    following[last] = np.inf
    low = np.full(len(scores), np.inf, np.float32)
    free = np.array([0, *range(1, moves.shape[0], 2)])
    for k in range(1, moves.shape[0]):
        begin, inside = k - 1 + k % 2, k + k % 2
        before = [p for p in range(moves.shape[0]) if moves[p, k] > -1e3]
        enter = (moves[before, 0] - moves[before, k]).min()
        stop = (moves[0, free] - moves[k, free]).min()
        go_on = moves[0, begin] - moves[k, inside] + min((moves[begin, r] - moves[inside, r]) for r in (*free, inside))
        low = np.minimum(low, scores[:, 0] - scores[:, k] + enter + np.minimum(stop, go_on + following[:, begin // 2]))
    return low > 1e-3


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, moves: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """The best labels of runs of rows of ``scores``, many runs of like length at a time; before and after a run is
    outside."""
    out = np.zeros(len(scores), np.int8)
    order = np.argsort(lengths, kind="stable")
    for low in range(0, len(order), chunk):
        runs = order[low : low + chunk]
        size, longest = lengths[runs], int(lengths[runs].max())
        at = starts[runs][:, None] + np.minimum(np.arange(longest), size[:, None] - 1)
        e = scores[at]
        best = e[:, 0] + moves[0]
        back = np.zeros((longest, len(runs), len(moves)), np.int8)
        for t in range(1, longest):
            reach = best[:, :, None] + moves
            back[t] = reach.argmax(1)
            best = np.where((t < size)[:, None], reach.max(1) + e[:, t], best)
        label = (best + moves[:, 0]).argmax(1).astype(np.int8)
        rows = np.arange(len(runs))
        for t in range(longest - 1, -1, -1):
            live = t < size
            out[at[live, t]] = label[live]
            label = np.where(live & (t > 0), back[t, rows, label], label)
    return out
