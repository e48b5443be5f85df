import math
import sys
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_model as lm
from tidemark.llm import recurrent

FOLDER = "/root/testdata/sf0.001/documents.parquet"


def base_scores(docs):
    rows = docs.collect()
    tokens = [[*brute.words(r.text), None] for r in rows]
    out = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows]
    counts = Counter(t for own, held in zip(tokens, out, strict=True) if not held for t in own)
    n, v = sum(counts.values()), len(counts)
    return [(r.doc_id, held, len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own))
            for r, own, held in zip(rows, tokens, out, strict=True)]


def check(spark, docs):
    got = sorted((tuple(r) for r in lm.language_scores(spark, docs).collect()), key=lambda r: str(r[:4]) + f"{r[5]:.4f}")
    want = sorted(base_scores(docs), key=lambda r: str(r[:4]) + f"{r[5]:.4f}")
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9, abs=1e-9)
    assert all(math.isfinite(r[6]) and r[6] <= 0 for r in got)
    return got


def test_base_equals_brute_force_and_the_model_is_better(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    monkeypatch.setattr(lm, "FREQUENT", 1 << 12)  # so that most words are joined
    got = check(spark, docs)
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_awkward_rows(spark, awkward, nothing):
    check(spark, awkward.where("doc_id is null or doc_id <> 18").withColumns({n: F.lit(1) for n in ("row", "token", "count", "model")}))
    assert lm.language_scores(spark, nothing).count() == 0
    alone = spark.createDataFrame([(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2), "never seen words")], "doc_id long, text string")
    row = lm.language_scores(spark, alone).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (4, 0, 0, 0.0)


def test_words_share_one_unit_of_probability():
    counts = np.arange(5000, 5000 - 3000, -1)
    weights = recurrent.start(counts, rest=700)
    states = np.random.default_rng(0).standard_normal((1, recurrent.STATE)).astype(np.float32)
    words = np.append(np.arange(recurrent.WORDS), recurrent.REST)
    total = np.exp(recurrent.log_probability(weights, np.repeat(states, len(words), axis=0), words)).sum()
    assert total == pytest.approx(1, abs=1e-3)


def test_gradient_equals_differences():
    draw = np.random.default_rng(2)
    weights = recurrent.start(np.arange(9000, 9000 - recurrent.WORDS, -1), 1000)
    weights = recurrent.Weights(*[x + (draw.standard_normal(x.shape) * 0.05).astype(np.float32) for x in weights.arrays()])
    tokens = draw.integers(0, recurrent.WORDS + 1, (6, 3))
    real = np.ones((6, 3), bool)
    real[4:, 2] = False

    def loss(w):
        state, states, s = np.zeros((3, recurrent.STATE)), [], recurrent.STATE
        inputs = w.words @ w.read + w.read_bias
        for step in range(6):
            states.append(state)
            read, kept = inputs[tokens[step]], state @ w.keep
            gates = 1 / (1 + np.exp(-(read[:, :2 * s] + kept[:, :2 * s])))
            fresh = np.tanh(read[:, 2 * s:] + gates[:, s:] * kept[:, 2 * s:])
            state = fresh + gates[:, :s] * (state - fresh)
        return -recurrent.log_probability(w, np.stack(states)[real], tokens[real]).sum() / real.sum()

    gradient, _ = recurrent._window_gradient(weights, np.zeros((3, recurrent.STATE), np.float32), tokens, real)
    exact = recurrent.Weights(*[x.astype(np.float64) for x in weights.arrays()])
    for value, slope in zip(exact.arrays(), gradient.arrays(), strict=True):
        at = np.unravel_index(np.argmax(abs(slope)), slope.shape)
        kept, step = value[at], 1e-5
        value[at] = kept + step
        up = loss(exact)
        value[at] = kept - step
        down = loss(exact)
        value[at] = kept
        assert slope[at] == pytest.approx((up - down) / 2 / step, rel=1e-3)


def test_state_is_carried_over_windows():
    draw = np.random.default_rng(4)
    weights = recurrent.start(np.arange(9000, 9000 - recurrent.WORDS, -1), 1000)
    docs = [draw.integers(0, recurrent.WORDS + 1, n) for n in (1, 5, 64, 65, 300, 64)]
    whole = recurrent.score(weights, docs, window=1000)
    assert recurrent.score(weights, docs, width=2, window=7) == pytest.approx(whole, rel=1e-5)


def test_lookup_finds_all_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 50_000, dtype=np.uint64))
    keys[:40] = np.arange(40)  # many with the same leading bits
    lookup = lm.Lookup(keys)
    assert (lookup.find(keys) == np.arange(len(keys))).all()
    assert (lookup.find(keys[40:] + np.uint64(1)) == -1).all()
    assert (lm.Lookup(keys[:0]).find(keys) == -1).all()


def test_learner_gets_every_training_document(spark, tmp_path):
    docs = spark.read.parquet(FOLDER).select("doc_id", "text").where(~lm.held_out(F.col("doc_id")))
    counts = docs.select("text").mapInArrow(lm._counted, "token long, count long").groupBy("token").agg(F.sum("count").alias("count"))
    vocabulary, _ = lm._vocabulary(counts)
    lm.train(docs, vocabulary, str(tmp_path))
    assert spark.read.parquet(*map(str, tmp_path.glob("weights-*"))).agg(F.sum("seen")).first()[0] == vocabulary.total


def test_rarer_words_have_classes_of_their_own():
    counts = np.sort(np.random.default_rng(3).zipf(1.3, 20_000).clip(1, 10_000))[::-1]
    v = lm.Vocabulary(np.arange(len(counts)), counts, int(counts.sum()) + 30, len(counts) + 20)
    rarer = v.numbers[recurrent.WORDS:-1][v.counts[recurrent.WORDS:] > 1]
    assert len(rarer) and (rarer > recurrent.REST).all() and len(set(rarer)) > 1
    assert (v.numbers[:-1][v.counts == 1] == recurrent.REST).all() and v.numbers[-1] == recurrent.REST
    weights = recurrent.start(v.counts[:v.own], v.rest_total, v.bands)
    states = np.random.default_rng(0).standard_normal((2, recurrent.STATE)).astype(np.float32)
    one, other = (recurrent.log_probability(weights, np.repeat(s[None], len(v.numbers), axis=0), v.numbers) for s in states)
    banded = v.numbers > recurrent.REST
    assert len(np.unique((one - other)[banded].round(9))) == len(set(rarer))  # a state moves each band by itself
    rest = v.numbers == recurrent.REST
    inside = np.where(rest, 0, one + np.log(10) * v.within)
    share = np.exp(one[rest][0])
    assert np.exp(inside[~rest]).sum() + share == pytest.approx(1, abs=1e-3)


def test_learning_takes_the_step_of_the_whole_gradient_once():
    """A learner's step equals Adagrad over all weights; numbers no token has do not move."""
    draw = np.random.default_rng(5)
    document = draw.integers(0, recurrent.NUMBERS, 20)
    counts = np.arange(9000, 9000 - recurrent.WORDS, -1)
    learner, weights = recurrent.Learner(recurrent.start(counts, 1000)), recurrent.start(counts, 1000)
    learner.learn([document])
    gradient, _ = recurrent._window_gradient(weights, np.zeros((1, recurrent.STATE), np.float32), document[:, None], np.ones((20, 1), bool))
    for value, change, moved in zip(weights.arrays(), gradient.arrays(), learner.w.arrays(), strict=True):
        assert moved == pytest.approx(value - learner.rate * change / (np.abs(change) + 1e-6), abs=1e-6)
    unread = np.setdiff1d(np.arange(recurrent.NUMBERS), document)
    assert (learner.w.words[unread] == weights.words[unread]).all()


def test_log_probability_holds_for_steep_logits():
    draw = np.random.default_rng(6)
    weights = recurrent.start(np.arange(9000, 9000 - recurrent.WORDS, -1), 1000)
    states = (draw.standard_normal((50, recurrent.STATE)) * 400).astype(np.float32)
    weights.to_class *= 50
    tokens = draw.integers(0, recurrent.NUMBERS, 50)
    found = recurrent.log_probability(weights, states, tokens)
    exact = recurrent.Weights(*[x.astype(np.float64) for x in weights.arrays()])
    assert np.isfinite(found).all() and (found <= 1e-6).all()
    assert found == pytest.approx(recurrent.log_probability(exact, states.astype(np.float64), tokens), rel=1e-4, abs=1e-2)


def test_a_window_takes_few_calls():
    """Classes are small, so what a window costs follows the calls into numpy more than the numbers."""
    draw = np.random.default_rng(7)
    weights = recurrent.start(np.arange(9000, 9000 - recurrent.WORDS, -1), 1000)
    tokens, state = draw.integers(0, recurrent.WORDS, (20, 64)), np.zeros((64, recurrent.STATE), np.float32)
    calls = 0

    def count(frame, event, argument):
        nonlocal calls
        calls += event == "c_call"

    sys.setprofile(count)
    try:
        recurrent._window_gradient(weights, state, tokens, np.ones((20, 64), bool))
    finally:
        sys.setprofile(None)
    assert calls < 300


def test_a_step_leaves_out_classes_without_a_token(monkeypatch):
    """The end of a long text is learned alone, a few tokens at a time; each step moved the vectors of all words."""
    moved, descend = [], recurrent._descend

    def counted(value, *others):
        moved.append(value.size)
        descend(value, *others)

    monkeypatch.setattr(recurrent, "_descend", counted)
    learner = recurrent.Learner(recurrent.start(np.arange(9000, 9000 - recurrent.WORDS, -1), 1000))
    learner.learn([np.random.default_rng(8).integers(0, 4 * recurrent.CLASS_WORDS, 20)])
    assert sum(moved) < recurrent.WORDS * recurrent.STATE / 4


def test_texts_of_a_window_stand_as_in_the_documents():
    documents = [np.arange(n) + 100 * n for n in (5, 1, 0, 9)]
    tokens, real = recurrent._Texts(documents).window(np.array([3, 0, 1]), 4, 3)
    assert tokens.T.tolist() == [[904, 905, 906], [504, recurrent.REST, recurrent.REST], [recurrent.REST] * 3]
    assert real.T.tolist() == [[True] * 3, [True, False, False], [False] * 3]
