"""A gated recurrent unit with a class-factored output, in numpy.

Words are numbered 0 .. WORDS-1 by falling frequency; class k holds words 64k .. 64k+63. Rarer words are numbered
by bands of frequency, REST+1 .. REST+BANDS, each a class of its own, and REST is the class of every other word. The
state before a token predicts the token's class, and its place within the classes of 64; then the state reads
the token. Starting output biases are the log frequencies, so the
untrained model is the unigram model.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

CLASS_WORDS = 64
CLASSES = 64
WORDS = CLASSES * CLASS_WORDS
REST = WORDS  # the number of every word outside the vocabulary
BANDS = 64
NUMBERS = WORDS + 1 + BANDS
STATE = 24
INPUT = 16
ABSENT = -30.0
FEW_CLASSES = 16  # up to so many, classes are moved one by one
PART = 1 << 14  # weights whose step stays in a core's cache
BLOCK = 4096  # tokens whose logits stay in a core's cache
SAFE = 60.0  # exponents up to it neither overflow nor vanish in float32


@dataclass
class Weights:
    """Parameters, or their gradients, as float32 arrays."""

    words: np.ndarray  # input vector of each number: words, the rest, bands
    read: np.ndarray  # input to update gate, reset gate and candidate
    read_bias: np.ndarray
    keep: np.ndarray  # state to the same three
    to_class: np.ndarray
    class_bias: np.ndarray
    to_word: np.ndarray  # output vector of each word
    word_bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in self.arrays()])

    def like(self, flat: np.ndarray) -> Weights:
        parts, at = [], 0
        for x in self.arrays():
            parts.append(flat[at:at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Weights(*parts)

    def over(self, flat: np.ndarray) -> Weights:
        """The same shapes over one array, without a copy."""
        ends = np.cumsum([x.size for x in self.arrays()])
        return Weights(*[part.reshape(x.shape) for part, x in zip(np.split(flat, ends[:-1]), self.arrays(), strict=True)])

    def zeros(self) -> Weights:
        return Weights(*[np.zeros_like(x) for x in self.arrays()])


def start(counts: np.ndarray, rest: int, bands: np.ndarray | None = None) -> Weights:
    """Weights of the unigram model: ``counts`` of the words by falling frequency, of the ``bands``, and ``rest`` of all other tokens."""
    draw = np.random.Generator(np.random.PCG64(11))

    def small(*shape):
        return (draw.standard_normal(shape) * 0.1).astype(np.float32)

    padded = np.zeros(WORDS)
    padded[:len(counts)] = counts
    by_class = padded.reshape(CLASSES, CLASS_WORDS)
    sums = np.concatenate([by_class.sum(axis=1), [rest + 1], np.zeros(BANDS) if bands is None else bands])
    class_bias = np.where(sums > 0, np.log(np.maximum(sums, 1) / sums.sum()), ABSENT)
    share = by_class / np.maximum(sums[:CLASSES, None], 1)
    word_bias = np.where(by_class > 0, np.log(np.maximum(share, 1e-12)), ABSENT)
    return Weights(small(NUMBERS, INPUT), small(INPUT, 3 * STATE), np.zeros(3 * STATE, np.float32), small(STATE, 3 * STATE),
                   small(STATE, len(sums)) * 0.1, class_bias.astype(np.float32), small(WORDS, STATE) * 0.1,
                   word_bias.reshape(-1).astype(np.float32))


def _gate(x: np.ndarray) -> np.ndarray:
    """The logistic function of ``-x``, in place; the weights of gates are negated once instead of every step."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _classes(tokens: np.ndarray) -> np.ndarray:
    return np.where(tokens < WORDS, tokens // CLASS_WORDS, tokens - WORDS + CLASSES)


def _by_class(classes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The rows of classes of single words, class after class, and where each class (number, start, end) stands among them."""
    order = np.argsort(classes.astype(np.uint8), kind="stable")  # short numbers are sorted by their digits
    edges = np.concatenate([[0], np.cumsum(np.bincount(classes, minlength=CLASSES)[:CLASSES])])
    spans = zip(range(CLASSES), edges[:-1].tolist(), edges[1:].tolist(), strict=True)
    return order[:edges[-1]], [span for span in spans if span[1] < span[2]]


def _shift(logits: np.ndarray) -> None:
    """Move each row into the range of exponents, in place; rows that are there stay as they are."""
    if logits.size and not (logits.max() < SAFE and logits.min() > -SAFE):
        logits -= logits.max(axis=1, keepdims=True)


def _row_sums(values: np.ndarray) -> np.ndarray:
    """Sums of the rows, up to rounding that depends on where a row stands."""
    return values @ np.ones(values.shape[1], values.dtype)


def _word_logits(w: Weights, own: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Of states that stand class after class, the logits of the words of their class."""
    inner = np.empty((len(own), CLASS_WORDS), np.result_type(own, w.to_word))
    words, bias = w.to_word.reshape(CLASSES, CLASS_WORDS, STATE), w.word_bias.reshape(CLASSES, CLASS_WORDS)
    for k, low, high in spans:
        part = inner[low:high]
        np.dot(own[low:high], words[k].T, out=part)
        part += bias[k]
    return inner


def log_probability(w: Weights, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Natural log probability of each token by the state before it; of the class alone for bands and the rest."""
    classes = _classes(tokens)
    logits = states @ w.to_class
    logits += w.class_bias
    _shift(logits)
    out = logits[np.arange(len(tokens)), classes].astype(np.float64)
    out -= np.log(np.exp(logits, out=logits).sum(axis=1))
    rows, spans = _by_class(classes)
    inner = _word_logits(w, states[rows], spans)
    _shift(inner)
    found = inner[np.arange(len(rows)), tokens[rows] % CLASS_WORDS].astype(np.float64)
    out[rows] += found - np.log(np.exp(inner, out=inner).sum(axis=1))
    return out


class _Texts:
    """Documents in one array, so that a window over many of them is taken by one call."""

    def __init__(self, documents: list[np.ndarray]):
        self.lengths = np.array([len(d) for d in documents], np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.tokens = np.concatenate([np.empty(0, np.int64), *documents])

    def window(self, group: np.ndarray, begin: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens by step and document from place ``begin`` on, and which of them the documents hold."""
        places = np.arange(begin, begin + steps)[:, None]
        real = places < self.lengths[group]
        tokens = self.tokens.take(places + self.first[group], mode="clip")
        tokens[~real] = REST
        return tokens, real


def score(w: Weights, documents: list[np.ndarray], width: int = 512, window: int = 64) -> np.ndarray:
    """Log probability of every whole document, its state carried from window to window."""
    total = np.zeros(len(documents))
    texts = _Texts(documents)
    lengths = texts.lengths
    order = np.argsort(-lengths, kind="stable")
    signs = np.repeat(np.float32([-1, -1, 1]), STATE)
    inputs = np.split((w.words @ w.read + w.read_bias) * signs, 3, axis=1)
    inputs, keep = [np.ascontiguousarray(x) for x in inputs], [np.ascontiguousarray(x) for x in np.split(w.keep * signs, 3, axis=1)]
    for low in range(0, len(order), width):
        group = order[low:low + width]
        sizes = lengths[group]
        state = np.zeros((len(group), STATE), np.float32)
        for begin in range(0, int(sizes[0]), window):
            active = int(np.searchsorted(-sizes, -begin, "left"))  # the documents that reach this window stand first
            steps = min(window, int(sizes[0]) - begin)
            tokens, real = texts.window(group[:active], begin, steps)
            states = np.empty((steps, active, STATE), np.float32)
            state = state[:active]
            for step in range(steps):
                states[step] = state
                update, reset, fresh = (x.take(tokens[step], axis=0) for x in inputs)
                update += state @ keep[0]
                reset += state @ keep[1]
                kept = state @ keep[2]
                kept *= _gate(reset)
                fresh += kept
                np.tanh(fresh, out=fresh)
                state = state - fresh
                state *= _gate(update)
                state += fresh
            hidden, target, place = states[real], tokens[real], np.nonzero(real)[1]
            for first in range(0, len(target), BLOCK):
                rows = slice(first, first + BLOCK)
                total[group[:active]] += np.bincount(place[rows], log_probability(w, hidden[rows], target[rows]), active)
    return total


def _window_gradient(
    w: Weights, state: np.ndarray, tokens: np.ndarray, real: np.ndarray, g: Weights | None = None
) -> tuple[Weights, np.ndarray]:
    """The gradient of one window's loss per token, and the state after it.

    It goes into ``g``, where vectors of words must be zero; those of words that have no part in it are left so. Within the window a step's arrays are turned, one row per unit, so that the parts of a gate lie together.
    """
    steps, width = tokens.shape
    states, fresh = np.empty((2, steps, STATE, width), np.float32)
    gates, kept = np.empty((steps, 2 * STATE, width), np.float32), np.empty((steps, 3 * STATE, width), np.float32)
    vectors = w.words.take(tokens.reshape(-1), axis=0).reshape(steps, width, INPUT).transpose(0, 2, 1)
    signs = np.repeat(np.float32([-1, -1, 1]), STATE)
    inputs = np.matmul((w.read * signs).T, vectors)
    inputs += (w.read_bias * signs)[:, None]
    keep, state = np.ascontiguousarray((w.keep * signs).T), np.ascontiguousarray(state.T)
    for step in range(steps):
        states[step] = state
        gate, new, through = gates[step], fresh[step], kept[step]
        np.dot(keep, state, out=through)
        np.add(inputs[step, :2 * STATE], through[:2 * STATE], out=gate)
        _gate(gate)
        np.multiply(gate[STATE:], through[2 * STATE:], out=new)
        new += inputs[step, 2 * STATE:]
        np.tanh(new, out=new)
        state = state - new
        state *= gate[:STATE]
        state += new
    g = w.zeros() if g is None else g
    hidden, target = states.transpose(0, 2, 1)[real], tokens[real]
    classes, scale = _classes(target), np.float32(1 / max(len(target), 1))
    share = hidden @ w.to_class
    share += w.class_bias
    _shift(share)
    np.exp(share, out=share)
    share *= (scale / _row_sums(share))[:, None]
    share[np.arange(len(target)), classes] -= scale
    np.dot(hidden.T, share, out=g.to_class)
    np.sum(share, axis=0, out=g.class_bias)
    back = share @ w.to_class.T
    rows, spans = _by_class(classes)
    if spans:
        own = hidden[rows]
        inner = _word_logits(w, own, spans)
        _shift(inner)
        np.exp(inner, out=inner)
        inner *= (scale / _row_sums(inner))[:, None]
        inner[np.arange(len(rows)), target[rows] % CLASS_WORDS] -= scale
        own_back = np.empty_like(own)
        words, g_words, g_bias = (x.reshape(CLASSES, CLASS_WORDS, -1) for x in (w.to_word, g.to_word, g.word_bias))
        for k, low, high in spans:
            part = inner[low:high]
            np.dot(part.T, own[low:high], out=g_words[k])
            np.dot(part, words[k], out=own_back[low:high])
        g_bias[[k for k, _, _ in spans], :, 0] = np.add.reduceat(inner, [low for _, low, _ in spans], axis=0)
        back[rows] += own_back
    outer = np.zeros((steps, width, STATE), np.float32)
    outer[real] = back
    outer = np.ascontiguousarray(outer.transpose(0, 2, 1))
    # What does not depend on the gradient of the state is worked out for all steps at once.
    update, reset = gates[:, :STATE], gates[:, STATE:]
    by_update = states - fresh
    by_update *= update
    by_fresh = 1 - update
    by_update *= by_fresh
    fresh *= fresh
    by_fresh *= np.subtract(1, fresh, out=fresh)
    by_reset = kept[:, 2 * STATE:] * reset
    by_reset *= 1 - reset
    slopes = np.empty((steps, 4 * STATE, width), np.float32)  # of update gate, reset gate, kept part and candidate
    d_state = np.zeros((STATE, width), np.float32)  # truncated: nothing comes back from the next window
    for step in range(steps - 1, -1, -1):
        slope = slopes[step]
        d_fresh = slope[3 * STATE:]
        np.multiply(d_state, by_fresh[step], out=d_fresh)
        np.multiply(d_state, by_update[step], out=slope[:STATE])
        np.multiply(d_fresh, by_reset[step], out=slope[STATE:2 * STATE])
        np.multiply(d_fresh, reset[step], out=slope[2 * STATE:3 * STATE])
        d_state *= update[step]
        d_state += w.keep @ slope[:3 * STATE]
        d_state += outer[step]
    turned = slopes.transpose(0, 2, 1)
    np.sum(np.matmul(states, turned[:, :, :3 * STATE]), axis=0, out=g.keep)
    of_input = np.r_[:2 * STATE, 3 * STATE:4 * STATE]
    g.read[:] = np.matmul(vectors, turned).sum(axis=0)[:, of_input]
    g.read_bias[:] = slopes.sum(axis=(0, 2))[of_input]
    read = np.zeros((4 * STATE, INPUT), np.float32)
    read[of_input] = w.read.T
    ordered = tokens.reshape(-1).astype(np.uint16)
    order = np.argsort(ordered, kind="stable")
    ordered = ordered[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    g.words[ordered[starts]] = np.add.reduceat(np.matmul(turned, read).reshape(-1, INPUT)[order], starts, axis=0)
    return g, np.ascontiguousarray(state.T)


def _descend(value: np.ndarray, square: np.ndarray, change: np.ndarray, rate: float, step: np.ndarray) -> None:
    """One Adagrad step, in place; ``step`` is room for it."""
    np.multiply(change, change, out=step)
    square += step
    np.sqrt(square, out=step)
    step += 1e-6
    np.divide(change, step, out=step)
    step *= rate
    value -= step


class Learner:
    """Adagrad over truncated windows; documents of similar length share a batch."""

    def __init__(self, weights: Weights, rate: float = 0.05):
        self.rate, self.seen = rate, 0
        flat = weights.flat()
        gradient, squares = np.zeros((2, len(flat)), np.float32)
        self.w, self.gradient, self.squares = (weights.over(x) for x in (flat, gradient, squares))
        self.room = np.empty(PART, np.float32)

        def parts(low: int, high: int, size: int) -> list[tuple[np.ndarray, ...]]:
            """Parts of the weights that stand one after the other, each small enough to stay in a core's cache."""
            edges = [*range(low, high, size), high]
            return [(*(x[a:b] for x in (flat, squares, gradient)), self.room[:b - a]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

        end = len(flat) - self.w.word_bias.size
        first = end - self.w.to_word.size
        self.common = [*parts(self.w.words.size, first, PART), *parts(end, len(flat), PART)]
        self.output, self.by_class = parts(first, end, PART), parts(first, end, CLASS_WORDS * STATE)

    def _step(self, tokens: np.ndarray) -> None:
        """Move the weights. Words not read, and classes without a token, have no gradient, and nothing of theirs moves."""
        counts = np.bincount(tokens.reshape(-1), minlength=NUMBERS)
        present = np.flatnonzero(counts[:WORDS].reshape(CLASSES, CLASS_WORDS).any(axis=1))
        output = self.output if len(present) > FEW_CLASSES else [self.by_class[k] for k in present.tolist()]
        for value, square, change, room in self.common:
            _descend(value, square, change, self.rate, room)
        for value, square, change, room in output:
            _descend(value, square, change, self.rate, room)
            change.fill(0)
        self.gradient.word_bias.fill(0)
        read = np.flatnonzero(counts)
        value, square, change = (x.words.take(read, axis=0) for x in (self.w, self.squares, self.gradient))
        _descend(value, square, change, self.rate, np.empty_like(value))
        self.w.words[read], self.squares.words[read] = value, square
        self.gradient.words[read] = 0

    def learn(self, documents: list[np.ndarray], width: int = 64, window: int = 20) -> None:
        texts = _Texts(documents)
        order = np.argsort(-texts.lengths, kind="stable")
        for low in range(0, len(order), width):
            group = order[low:low + width]
            sizes = texts.lengths[group]
            state = np.zeros((len(group), STATE), np.float32)
            for begin in range(0, int(sizes[0]), window):
                active = int(np.searchsorted(-sizes, -begin, "left"))
                tokens, real = texts.window(group[:active], begin, min(window, int(sizes[0]) - begin))
                _, state = _window_gradient(self.w, state[:active], tokens, real, self.gradient)
                self._step(tokens)
                self.seen += int(real.sum())
