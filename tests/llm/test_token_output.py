import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import token_output as to
from tidemark.session import work_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
NASTY = ["", None, "  a  b ", "\n\n x\ty \n", "it's 'S don't", " a  b", "é à b  c　d", "  ", "\n", " <|endoftext|> x", "a\x1c b\x85 c  d",
         "日本 語　 です", "   z\n\n\nq   ", "x" * 100_000 + " y", "  a  b", "😀 😀​ x", "\x00 a \x7f b"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, to.END]


def test_pieces_give_the_tokens_of_whole_texts(tokenizer):
    ids_, bounds = to.encode_column(pa.array(NASTY * 2), PATH)
    for i, text in enumerate(NASTY * 2):
        assert ids_[bounds[i]:bounds[i + 1]].tolist() == ids(tokenizer, text)[:-1]


def test_special_tokens_in_texts(tokenizer):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "q  <|endoftext|>\n z", "<|endoftext |> a"]
    ids_, bounds = to.encode_column(pa.array(texts), PATH)
    assert [ids_[bounds[i]:bounds[i + 1]].tolist() for i in range(len(texts))] == [ids(tokenizer, t)[:-1] for t in texts]
    assert ids_[bounds[0]:bounds[1]].tolist() == [64, 220, 50256, 275]
    assert 50256 not in to.encode_column(pa.array(texts), PATH, specials_are_text=True)[0]


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_known_pieces_change_nothing(tokenizer, most):
    draw = np.random.default_rng(3)
    known = to.KnownPieces(most)
    for _ in range(6):
        texts = [" ".join(f"word{n}" for n in draw.zipf(1.3, 80) % 500) for _ in range(20)] + NASTY
        ids_, bounds = to.encode_column(pa.array(texts), PATH, known=known)
        assert [ids_[bounds[i]:bounds[i + 1]].tolist() for i in range(len(texts))] == [ids(tokenizer, t)[:-1] for t in texts]
        assert len(known.hashes) <= most and (np.diff(known.hashes.astype(object)) > 0).all()


def check(spark, tokenizer, docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for i, text in rows:
        own = ids(tokenizer, text)
        want.append((i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert sorted(map(tuple, to.stored_tokens(spark, docs, PATH).collect()), key=lambda r: r[1]) == want


def test_files_hold_every_document_in_order(spark, tokenizer):
    check(spark, tokenizer, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(7))


def test_awkward_rows(spark, tokenizer, awkward, nothing):
    more = spark.createDataFrame([(100 - i, t) for i, t in enumerate(NASTY)], "doc_id long, text string")
    docs = awkward.where("length(text) < 1000000 or text is null").select("doc_id", "text").union(more)
    check(spark, tokenizer, docs.withColumns({n: F.lit(1) for n in ("start", "shard", "tokens", "n_tokens")}))
    assert to.stored_tokens(spark, nothing, PATH).count() == 0


def test_selective_reads_and_layout(spark):
    path = f"{work_dir(spark, 'tokens')}/files"
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    to.write_tokens(docs, path, PATH)
    assert to.read_tokens(spark, path, 10, 19).count() == 10
    plan = to.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan
    name = next(p for p in spark.read.parquet(path).inputFiles()).removeprefix("file:")
    column = {c.path_in_schema: c for c in (pq.ParquetFile(name).metadata.row_group(0).column(i) for i in range(5))}
    assert any("DICTIONARY" in e for e in column["tokens.list.element"].encodings)
    assert "DELTA_BINARY_PACKED" in column["start"].encodings
    assert column["doc_id"].has_column_index and column["doc_id"].has_offset_index


def test_a_worker_keeps_pieces_over_its_tasks(monkeypatch):
    """A second task of a worker encodes no piece anew that the first one met twice; its ids are the same."""
    class Task:
        partitionId = staticmethod(lambda: 0)

    sizes, long = [], "y1" * 5000
    learn = to.KnownPieces.learn
    monkeypatch.setattr(to.TaskContext, "get", lambda: Task)
    monkeypatch.setattr(to.KnownPieces, "learn", lambda self, hashes, *rest: sizes.append(len(hashes)) or learn(self, hashes, *rest))
    to._known_pieces.cache_clear()
    texts = ["one two two three", None, "", f" {long} {long} one two <|endoftext|>", " four three"] * 2
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    encode = to._encode(PATH, to.END, False)
    first, second = ([out.to_pydict() for out in encode(iter([batch]))] for _ in range(2))
    known = to._known_pieces(PATH, False)
    assert first == second and sizes[0] > 2 and sizes[1] <= 2  # the long piece is not kept
    assert known.count.max() <= to.KNOWN_IDS and known is not to._known_pieces(PATH, True)
    to._known_pieces.cache_clear()
