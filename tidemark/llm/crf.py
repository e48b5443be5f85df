"""A linear-chain conditional random field over the tokens of a document.

Tags are outside, begin and inside; inside follows begin or inside only. A token is described by its own
shape, the words around it and features of its whole file, all hashed into one table of weights. Training
is batched forward-backward with Adagrad; decoding is Viterbi over many documents at once.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Sequence
from zlib import crc32

import numpy as np

OUTSIDE, BEGIN, INSIDE = range(3)
TABLE = 1 << 15
OWN, AROUND, FILE = 7, 4, 4
FEATURES = OWN + AROUND + FILE
TOKEN = re.compile(r"\w+|[^\w\s]")
CACHE = 200_000

_PIECES = re.compile(r"[0-9]+|[a-z]+|[A-Z]+|[^0-9a-zA-Z]+")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_NEVER = -1e9
_ALLOWED = np.array([[True, True, False], [True, True, True], [True, True, True]])


def _feature(name: str) -> int:
    return crc32(name.encode()) % TABLE


def _length(n: int) -> int:
    return n if n <= 4 else 5 + bisect_left((7, 11, 15, 19, 31, 63), n)


def _shape(token: str) -> str:
    """The shape of a token that isn't all letters."""
    if not (token[0].isalnum() or token[0] == "_"):
        return token
    if token.isdigit():
        return "digits"
    if _HEX.fullmatch(token):
        return "hex"
    return "code" if token.isalnum() else "name" if not any(c.isdigit() for c in token) else "named code"


_PLACES = ("one before", "two before", "one after", "last word")
_SPREAD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64)
_EDGE = np.array([_feature(place) for place in _PLACES])


def _around(words: np.ndarray) -> np.ndarray:
    """For word hashes the feature each has as a neighbour in every place."""
    mixed = words[:, None].astype(np.uint64) * _SPREAD
    return ((mixed >> np.uint64(20)) % np.uint64(TABLE)).astype(np.int64)


class Types(dict):
    """Token types by number, kept from text to text up to a bound.

    Tokens of one shape, size and variety form a class; a class has features and flags, and a type adds
    the hash of the word that its neighbours see.
    """

    def __init__(self):
        super().__init__()
        self.class_of: list[int] = []
        self.words: list[int] = []
        self.classes: dict[tuple, int] = {}
        self.own: list[tuple[int, ...]] = []
        self.flags: list[tuple[bool, bool, bool, int]] = []
        self._arrays = self._no_arrays()

    @staticmethod
    def _no_arrays() -> tuple[np.ndarray, np.ndarray]:
        return np.empty(0, np.int64), np.empty((0, AROUND), np.int64)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """The class of every type, and its features as a neighbour; only types that are new are worked out."""
        kinds, near = self._arrays
        have = len(kinds)
        if have < len(self.words):
            self._arrays = (np.concatenate([kinds, np.array(self.class_of[have:], np.int64)]),
                            np.concatenate([near, _around(np.array(self.words[have:], np.int64))]))
        return self._arrays

    def __missing__(self, token: str) -> int:
        n, word = len(token), token.isalpha()
        size, variety = _length(n), min(len(set(token)) // 3, 6)
        if word:
            shape = "lower" if token.islower() else "upper" if token.isupper() else "title" if token[1:].islower() else "mixed"
            pieces = digits = 0
        else:
            shape, pieces = _shape(token), min(len(_PIECES.findall(token)), 8)
            digits = sum(c.isdigit() for c in token)
        key = shape, size, variety, pieces, digits and 1 + 4 * digits // n
        kind = self.classes.get(key)
        if kind is None:
            kind = self.classes[key] = len(self.own)
            self.own.append(tuple(map(_feature, ("bias", f"n {size}", f"s {shape}", f"sn {shape} {size}", f"p {pieces} {size}",
                                                 f"v {variety} {size}", f"d {key[-1]} {size}"))))
            self.flags.append((word, digits > 0, shape == token and n == 1, size if digits and n > 4 else 0))
        seen = token.lower() if word and n <= 12 else shape if n == 1 else f"# {shape} {size}"
        self.class_of.append(kind)
        self.words.append(crc32(seen.encode()))
        at = self[token] = len(self.words) - 1
        return at

    def number(self, tokens: list[str]) -> np.ndarray:
        if len(self.words) > CACHE:
            self.clear()
            self.class_of.clear()
            self.words.clear()
            self._arrays = self._no_arrays()
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))

    def flag(self, numbers: np.ndarray, which: int) -> np.ndarray:
        """A flag of every token: word, digits, sign or oddness."""
        kinds = self.arrays()[0][numbers]
        return np.array([flags[which] for flags in self.flags] or [0])[kinds]


WORD, DIGITS, SIGN, ODD = range(4)


def places(starts: np.ndarray, is_word: np.ndarray) -> np.ndarray:
    """For each token the tokens one before, two before, one after, and the last word before; -1 at an edge."""
    here = np.arange(len(is_word))
    first = np.repeat(starts[:-1], np.diff(starts))
    last = np.repeat(starts[1:], np.diff(starts)) - 1
    word = np.concatenate([[-1], np.maximum.accumulate(np.where(is_word, here, -1))[:-1]]) if len(here) else here
    out = np.stack([here - 1, here - 2, here + 1, word])
    out[(out < first) | (out > last)] = -1
    return out


def file_features(types: Types, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of every document: its size, its shares of signs and numbers, and its odd tokens."""
    def total(flags: np.ndarray) -> list[int]:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return (sums[starts[1:]] - sums[starts[:-1]]).tolist()

    out = np.empty((len(starts) - 1, FILE), np.int64)
    counts = [total(types.flag(numbers, which) > 0) for which in (SIGN, DIGITS, ODD)]
    for i, (n, signs, digits, odd) in enumerate(zip(np.maximum(np.diff(starts), 1).tolist(), *counts)):
        out[i] = [_feature(f"file {n.bit_length() // 2}"), _feature(f"signs {10 * signs // n}"), _feature(f"numbers {20 * digits // n}"), _feature(f"odd {min(odd, 4)}")]
    return out


def features(types: Types, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The feature numbers of every token, one row each."""
    kinds, known = types.arrays()
    around = np.concatenate([known, _EDGE[None]])
    near = [around[np.where(at < 0, -1, numbers[at]), slot] for slot, at in enumerate(places(starts, types.flag(numbers, WORD)))]
    own = np.array(types.own)[kinds[numbers]]
    return np.concatenate([own, np.stack(near, 1), np.repeat(file_features(types, numbers, starts), np.diff(starts), 0)], 1)


class Model:
    """Weights by feature and tag, and between neighbouring tags."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights.astype(np.float32), np.where(_ALLOWED, steps, _NEVER)
        self.slack = 2 * max(0.0, float(self.steps.max() - self.steps[OUTSIDE, OUTSIDE]))

    def emissions(self, types: Types, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of every token and tag, summed by class of token, by neighbour and by file."""
        w = self.weights
        if not len(numbers):
            return np.zeros((0, 3), np.float32)
        kinds, known = types.arrays()
        out = w[np.array(types.own)].sum(1)[kinds[numbers]]
        for slot, at in enumerate(places(starts, types.flag(numbers, WORD))):
            near = w[known[numbers[at], slot]]
            near[at < 0] = w[_EDGE[slot]]
            out += near
        return out + np.repeat(w[file_features(types, numbers, starts)].sum(1), np.diff(starts), 0)

    def _open(self, scores: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Whether each token could be part of a secret: some run around it must not lose against outside.

        A run of n tokens has n + 1 steps, each dearer by ``slack`` at most than one outside. The margin is
        far above what the sums can be off by.
        """
        slack = self.slack / 2
        gain = (scores[:, 1:].max(1) - scores[:, 0]).astype(np.float64) + slack
        sizes = np.diff(starts)
        chain = np.repeat(np.arange(len(sizes)), sizes)
        upto = np.cumsum(gain)
        upto -= np.repeat((upto - gain)[starts[:-1]], sizes)
        apart = 2 * np.abs(upto).max() + np.abs(gain).max() + 1
        # Chains are set apart by more than any sum, so that a least or largest sum is one of the own chain.
        low = np.minimum.accumulate(upto - gain - chain * apart) + chain * apart
        high = np.maximum.accumulate((upto - chain * apart)[::-1])[::-1] + chain * apart
        return high - low + slack >= -0.01

    def tags(self, scores: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The best tags of every chain.

        A chain in which no token could win by being part of a secret, even with the dearest steps
        around it, is outside as a whole. Of the others the tokens that no run can win with are outside, and
        the stretches between them are decoded.
        """
        out = np.zeros(len(scores), np.int8)
        gain = scores[:, 1:].max(1) - scores[:, 0] + self.slack
        sizes = np.diff(starts)
        full = np.flatnonzero(sizes)
        hope = full[np.maximum.reduceat(gain, starts[full]) >= 0] if len(full) else full
        if not len(hope):
            return out
        own = np.concatenate([[0], np.cumsum(sizes[hope])])
        rows = np.repeat(starts[hope] - own[:-1], sizes[hope]) + np.arange(own[-1])
        may = self._open(scores[rows], own)
        edge = np.zeros(len(rows) + 1, bool)
        edge[own] = True
        first = np.flatnonzero(may & (edge[:-1] | ~np.append(False, may[:-1])))
        final = np.flatnonzero(may & (edge[1:] | ~np.append(may[1:], False))) + 1
        if not len(first):
            return out
        order = np.argsort(first - final, kind="stable")
        first, final = first[order], final[order]
        begin, length = rows[first], final - first
        back = np.zeros((int(length.sum()), 3), np.int8)
        place = np.concatenate([[0], np.cumsum(length)[:-1]])
        # Outside stands before and after a stretch, unless its chain begins or ends there.
        score = scores[begin] + np.where(edge[first, None], 0, self.steps[OUTSIDE])
        score[:, INSIDE] = _NEVER
        ends = np.empty_like(score)
        active = len(begin)
        for t in range(1, int(length[0])):
            still = int(np.searchsorted(-length, -t, "left"))
            ends[still:active] = score[still:active]
            score, active = score[:still], still
            ways = score[:, :, None] + self.steps
            choice = ways.argmax(1)
            back[place[:still] + t] = choice
            score = np.take_along_axis(ways, choice[:, None], 1)[:, 0] + scores[begin[:still] + t]
        ends[:active] = score
        tag = (ends + np.where(edge[final, None], 0, self.steps[:, OUTSIDE])).argmax(1)
        for t in range(int(length[0]) - 1, -1, -1):
            still = int(np.searchsorted(-length, -t, "left"))
            out[begin[:still] + t] = tag[:still]
            tag[:still] = back[place[:still] + t, tag[:still]]
        return out


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis, keepdims=True)
    return (np.log(np.exp(values - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def chain_loss(scores: np.ndarray, steps: np.ndarray, tags: np.ndarray, length: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of padded chains and its gradients by score and by step."""
    chains, longest, _ = scores.shape
    steps = np.where(_ALLOWED, steps, _NEVER)
    inside = np.arange(longest) < length[:, None]
    ahead = np.empty_like(scores)
    ahead[:, 0] = scores[:, 0]
    ahead[:, 0, INSIDE] = _NEVER
    for t in range(1, longest):
        step = _log_sum(ahead[:, t - 1, :, None] + steps, 1) + scores[:, t]
        ahead[:, t] = np.where(inside[:, t, None], step, ahead[:, t - 1])
    norm = _log_sum(ahead[:, -1], 1)
    behind = np.zeros_like(scores)
    pairs = np.zeros((3, 3))
    for t in range(longest - 2, -1, -1):
        on = inside[:, t + 1, None]
        later = scores[:, t + 1] + behind[:, t + 1]
        behind[:, t] = np.where(on, _log_sum(steps + later[:, None, :], 2), 0)
        both = np.exp(np.minimum(ahead[:, t, :, None] + steps + later[:, None] - norm[:, None, None], 0))
        pairs += (both * on[..., None]).sum(0)
    chance = np.exp(np.minimum(ahead + behind - norm[:, None, None], 0)) * inside[..., None]
    truth = np.eye(3)[tags] * inside[..., None]
    moves = (np.eye(3)[tags[:, :-1]][..., None] * np.eye(3)[tags[:, 1:]][:, :, None] * inside[:, 1:, None, None]).sum((0, 1))
    right = (scores * truth).sum() + (np.where(_ALLOWED, steps, 0) * moves).sum()
    return float(norm.sum() - right), chance - truth, np.where(_ALLOWED, pairs - moves, 0)


def fit(chains: Sequence[tuple[np.ndarray, np.ndarray]], epochs: int = 10, batch: int = 128, rate: float = 0.15, hide: float = 0.3, decay: float = 1e-4, seed: int = 5) -> Model:
    """Learn from chains of (features, tags).

    A share of the features of words around a token is hidden at random, so that shape has to carry
    some of the weight and an unknown neighbour does not decide.
    """
    draw = np.random.default_rng(seed)
    weights, steps = np.zeros((TABLE, 3)), np.zeros((3, 3))
    seen, seen_steps = np.full((TABLE, 3), 1e-6), np.full((3, 3), 1e-6)
    for _ in range(epochs):
        order = draw.permutation(len(chains))
        for low in range(0, len(order), batch):
            part = [chains[i] for i in order[low:low + batch]]
            length = np.array([len(tags) for _, tags in part])
            ids = np.zeros((len(part), length.max(), FEATURES), np.int64)
            tags = np.zeros(ids.shape[:2], np.int64)
            for row, (own, marks) in enumerate(part):
                ids[row, :len(marks)], tags[row, :len(marks)] = own, marks
            shown = np.ones(ids.shape)
            shown[..., OWN:OWN + AROUND] = draw.random((*ids.shape[:2], AROUND)) >= hide
            scores = (weights[ids] * shown[..., None]).sum(2)
            _, by_score, by_step = chain_loss(scores, steps, tags, length)
            n = length.sum()
            flat = ids.ravel()
            spread = (by_score[:, :, None] * shown[..., None]).reshape(-1, 3) / n * 100
            slope = np.stack([np.bincount(flat, spread[:, tag], TABLE) for tag in range(3)], 1)
            slope += decay * weights * (slope != 0)
            seen += slope**2
            weights -= rate * slope / np.sqrt(seen)
            by_step = by_step / n * 100
            seen_steps += by_step**2
            steps -= rate * by_step / np.sqrt(seen_steps)
    return Model(weights, steps)
