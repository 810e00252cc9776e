import hashlib

import pytest

pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

from cuelake.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "\n\n", "a", "it's we're 'tis  ok", "x" * 700, " " * 900, "a b\n\n\nc  d   e\t\t f" * 40,
    "x" * 150 + " a few words then " + "y" * 260 + " and the end of it " * 20, "tab\t" * 70 + "\r\n \r\n" * 30,
    "naïve 日本語 \U0001f600 text 123 4567 " * 30, "  word　 '" * 50, "we'll'll'll" * 60, "!?" * 400 + " end",
]


def whole(text):
    ids = bpe.codec(PATH).encoding.encode_ordinary(text or "")
    return len(ids), ",".join(map(str, ids)), (text or "").encode()


@pytest.mark.parametrize("chunk,overlap", [(8, 16), (64, 16), (100, 40), (65_536, 256)])
def test_chunks_equal_whole_encoding(spark, chunk, overlap):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id " * 30, "y"), (2, "tie " * 50, "z"), (2, "tie " * 50, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_csv, bytes(r.decoded)) for r in bpe.encode_decode(docs, PATH, chunk=chunk, overlap=overlap).collect())
    want = sorted((i is None, i, *whole(t)) for i, t, _ in rows)
    assert got == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.digests(bpe.encode_decode(docs, PATH)).collect() == []


def test_digests(spark):
    r = bpe.digests(bpe.encode_decode(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), PATH)).first()
    assert (r.ids_sha256, r.decoded_sha256) == (hashlib.sha256(whole("a b")[1].encode()).hexdigest(), hashlib.sha256(b"a b").hexdigest())


@pytest.mark.parametrize("text", ["b" + " " * 1_000_000 + "c d", "x " * 9_000 + "\n" * 300_000 + "y" * 70_000 + " z", "no" * 200_000])
def test_long_runs(spark, text):
    import regex

    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id bigint, text string")
    got = {r.doc_id: (r.ids_csv, bytes(r.decoded)) for r in bpe.encode_decode(docs, PATH).collect()}
    c = bpe.codec(PATH)
    ids = [i for m in regex.findall(public_tokenizers.PATTERN, text) for i in c.encoding._encode_single_piece(m)]
    assert got == {1: (",".join(map(str, ids)), text.encode()), 2: (whole("short")[1], b"short")}


def test_long_runs_leave_the_rest_in_pieces(spark):
    text = "word " * 100 + "x" * 300 + " more words" * 100
    rows = spark.createDataFrame([(1, 2, 1, text)], "doc_id bigint, _row bigint, copies bigint, text string")
    pieces = [r.text for r in bpe.long_pieces(rows, PATH, chunk=64, overlap=16).orderBy("piece").collect()]
    assert "".join(pieces) == text and len(pieces) > 20 and max(map(len, pieces)) < 500
