import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import crf, queries, secret_scan
from tidemark.llm.secret_rules import base_spans

FOLDER = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = {
    "assign": (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    "access": (r"(AKIA[A-Z0-9]+)", 18), "hex": (r"([0-9a-f]+)", 16),
}


def brute(text):
    text, found = text or "", []
    for order, (kind, (pattern, least)) in enumerate(PLAIN.items()):
        found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[1]) >= least]
    names = [x for *_, x in sorted(found)]
    return [sum(x.startswith(kind) for x in names) for kind in PLAIN], hashlib.sha256(",".join(names).encode()).hexdigest(), names


def check(rows, texts):
    assert len(rows) == len(texts)
    for row, text in zip(rows, texts):
        counts, digest, names = brute(text)
        assert [row.n_assign, row.n_access, row.n_hex] == counts and row.base_sha256 == digest
        spans = row.spans.split(",") if row.spans else []
        assert [x for x in spans if not x.startswith("tagged")] == names
        assert len(spans) == len(names) + row.n_tagged
        starts = [(int(x.split(":")[1]), [*PLAIN, "tagged"].index(x.split(":")[0])) for x in spans]
        assert starts == sorted(starts)


NASTY = [
    "token=secret: abcdefghijklmnop", "PASSWORD : 'abcdefghijk' passwd=abcdefghijkl", "apikey=ab api_key=" + "x" * 12, "ſecret=abcdefghijklm toKen=abcdefghijklm",
    "éé token = \"" + "0123456789abcdef" * 2 + "\" é AKIA" + "Z" * 14 + " AKIAAKIA" + "0" * 9, "AKIA" + "A" * 13 + " deadbeefdeadbee deadbeefdeadbeef", "token\n=abcdefghijklmn", "secret==abcdefghijk", "", None,
]


def test_base_spans_on_nasty_texts():
    for text in NASTY:
        spans = base_spans(text or "")
        assert [f"{[*PLAIN][k]}:{a}:{b}" for a, k, b, _ in spans] == brute(text)[2]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op13_secret_scan(spark, FOLDER).collect()
    check(rows, [texts[r.doc_id] for r in rows])


def test_awkward_rows(spark, awkward, nothing):
    df = awkward.union(spark.createDataFrame([(100 + i, t, None, None, None) for i, t in enumerate(NASTY)], DOCUMENTS))
    rows = secret_scan.secrets(spark, df.withColumns({"hit": F.lit(1), "order": F.lit("x"), "spans": F.lit(0)}).coalesce(1)).collect()
    check(rows, [r.text for r in df.collect()])
    assert secret_scan.secrets(spark, nothing).collect() == []
    assert {r.n_tagged for r in secret_scan.secrets(spark, awkward.where("doc_id < 10")).collect()} == {0}


def fields(seed, texts):
    types = crf.Types()
    numbers, starts = secret_scan._tokens(types, texts)
    draw = np.random.default_rng(seed)
    return types, numbers, starts, crf.Model(draw.normal(size=(crf.TABLE, 3)), draw.normal(size=(3, 3)))


def test_type_sums_equal_features():
    types, numbers, starts, model = fields(1, ["a token = \"x9\"", "", "é and 12 ab_c9, B", "one"])
    ids = crf.features(types, numbers, starts)
    assert ids.shape == (len(numbers), crf.FEATURES)
    np.testing.assert_allclose(model.weights[ids].sum(1), model.emissions(types, numbers, starts), atol=1e-4)


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_equals_all_paths(seed):
    draw = np.random.default_rng(seed)
    sizes = [3, 0, 1, 6, 5, 6, 2]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    scores = draw.normal(size=(starts[-1], 3)) * 2 - np.array([0, 1.5, 1.5]) * (seed % 2) * 4
    model = crf.Model(np.zeros((crf.TABLE, 3)), draw.normal(size=(3, 3)))
    got = model.tags(scores, starts)
    for low, high in zip(starts[:-1], starts[1:]):
        def value(path):
            if path[0] == crf.INSIDE:
                return -np.inf
            return sum(scores[low + i, t] for i, t in enumerate(path)) + sum(model.steps[a, b] for a, b in zip(path, path[1:]))
        if high > low:
            best = max(itertools.product(range(3), repeat=high - low), key=value)
            assert tuple(got[low:high]) == best


def test_gradient_and_likelihood():
    draw = np.random.default_rng(0)
    length, tags = np.array([4, 1, 3]), np.array([[0, 1, 2, 0], [1, 0, 0, 0], [0, 0, 1, 0]])
    scores, steps = draw.normal(size=(3, 4, 3)), draw.normal(size=(3, 3))
    loss, by_score, by_step = crf.chain_loss(scores, steps, tags, length)
    whole = 0.0
    for row, n in enumerate(length):
        def value(path):
            ok = path[0] != 2 and all((a, b) != (0, 2) for a, b in zip(path, path[1:]))
            return sum(scores[row, i, t] for i, t in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:])) if ok else -np.inf
        every = [value(path) for path in itertools.product(range(3), repeat=n)]
        whole += np.log(np.exp(every).sum()) - value(tuple(tags[row, :n]))
    assert abs(loss - whole) < 1e-9
    for at in itertools.product(range(3), range(4), range(3)):
        other = scores.copy()
        other[at] += 1e-6
        assert abs((crf.chain_loss(other, steps, tags, length)[0] - loss) / 1e-6 - by_score[at]) < 1e-4
    for at in itertools.product(range(3), range(3)):
        other = steps.copy()
        other[at] += 1e-6
        assert abs((crf.chain_loss(scores, other, tags, length)[0] - loss) / 1e-6 - by_step[at]) < 1e-4


def prose(draw, n):
    return [draw.choice("the of and house river stone over under blue green 12 7 1999 a, it. To".split()) for _ in range(n)]


def test_finds_what_the_patterns_miss_and_spares_the_rest(spark):
    draw = random.Random(2)
    rows = []
    for i in range(400):
        words = prose(draw, 60)
        if i % 2:
            words[30] = draw.choice(["token", "secret", "password"]) + ' = "' + "".join(draw.choice("0123456789abcdef") for _ in range(draw.choice([14, 20, 40]))) + '"'
        else:
            words[20] = f"write to mail.{draw.randint(10, 99)}@host{i}.example.com or {draw.randint(1, 255)}.{draw.randint(1, 255)}.7.9"
        rows.append((i, " ".join(words), "en", "a", 0))
    train = spark.createDataFrame(rows, DOCUMENTS)
    model = secret_scan.learned(train, 150)
    missed = [" ".join([*prose(draw, 30), f'token -> "{"".join(draw.choice("0123456789abcdef") for _ in range(14))}"', *prose(draw, 20)]) for _ in range(40)]
    clean = [" ".join([*prose(draw, 30), f"mail.{i}@host.example.com 10.2.{i}.4 in 1984", *prose(draw, 20)]) for i in range(40)]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(missed + clean)], DOCUMENTS)
    found = {r.doc_id: r for r in secret_scan.secrets(spark, df, model).collect()}
    assert not any(found[i].n_assign + found[i].n_hex for i in range(80))
    assert sum(found[i].n_tagged for i in range(40)) >= 36
    assert sum(found[i].n_tagged for i in range(40, 80)) <= 2
    held = spark.createDataFrame([(r[0], r[1].replace("blue", "red"), "en", "a", 0) for r in rows[300:]], DOCUMENTS)
    types, texts = crf.Types(), [r.text for r in held.collect()]
    for text, spans in zip(texts, secret_scan.tagged_spans(model, types, texts)):
        assert spans == [(begin, end) for _, _, end, begin in {s[3]: s for s in base_spans(text)}.values()]


def test_tags_of_known_secrets():
    text = 'a token = "abc.def-0123456789" b'
    assert secret_scan.secret_tags(text, base_spans(text)).tolist() == [0, 0, 0, 0, 1, 2, 2, 2, 2, 0, 0]


def plain_viterbi(scores, steps):
    score, back = np.where([True, True, False], scores[0], -1e9), []
    for row in scores[1:]:
        ways = score[:, None] + steps
        back.append(ways.argmax(0))
        score = ways.max(0) + row
    tags = [int(score.argmax())]
    for came in back[::-1]:
        tags.append(int(came[tags[-1]]))
    return tags[::-1]


@pytest.mark.parametrize("seed", range(6))
def test_stretches_decode_as_whole_chains(seed):
    """Only stretches that can hold a secret are decoded; the tags are those of the whole chains."""
    draw = np.random.default_rng(seed)
    sizes = draw.integers(0, 400, 30)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    scores = draw.normal(size=(starts[-1], 3)) * 2 - np.array([0, 6, 6])
    secret = draw.random(len(scores)) < 0.02
    scores[secret] += draw.normal(size=(secret.sum(), 1)) + np.array([0, 9, 9])
    steps = draw.normal(size=(3, 3)) * (1 + seed % 2)
    model = crf.Model(np.zeros((crf.TABLE, 3)), steps)
    got = model.tags(scores, starts)
    want = [tag for low, high in zip(starts[:-1], starts[1:]) if high > low for tag in plain_viterbi(scores[low:high], model.steps)]
    assert got.tolist() == want and any(want)
    if seed % 2 == 0:  # steps that differ much leave most tokens open
        full = np.concatenate([[0], np.cumsum(sizes[sizes > 0])])
        assert model._open(scores, full).mean() < 0.6


def test_types_are_turned_into_arrays_once(monkeypatch):
    worked = []
    around = crf._around
    monkeypatch.setattr(crf, "_around", lambda words: worked.append(len(words)) or around(words))
    types = crf.Types()
    model = crf.Model(np.zeros((crf.TABLE, 3)), np.zeros((3, 3)))
    for text in ("a b c 12", "b c d", "d a"):
        numbers, starts = secret_scan._tokens(types, [text])
        model.emissions(types, numbers, starts)
    assert sum(worked) == len(types.words) == 5


def test_has_find_equals_the_patterns(spark):
    texts = ["", "Passw", "PASSWORD: abcdefghijkl", "passwd='ABCdef123456'", "Api_Key = a1b2c3d4e5f6", "APIKEY:xxxxxxxxxxxx", "apikey abcdefghijkl",
             "secret=short", "é TOKEN=abcdefghijkl", "to\u212aen=abcdefghijkl", "\u017fecret=abcdefghijkl", "AKIAABCDEFGHIJKLMN", "akiaABCDEFGHIJKLMN",
             "AKIA123", "0123456789abcdef", "0123456789ABCDEF", "rapid capital", "İsecret=abcdefghijkl"]
    rules = [re.compile(rule, re.ASCII) for rule, _ in secret_scan._RULES]
    df = spark.createDataFrame([(text,) for text in texts], "text string")
    got = df.select("text", secret_scan.has_find(F.col("text")).alias("hit")).collect()
    assert {r.text: r.hit for r in got} == {text: any(rule.search(text) for rule in rules) for text in texts}
