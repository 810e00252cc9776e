import zlib

import numpy as np
import pytest

pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from cuelake.llm import token_output as t  # noqa: E402
from cuelake.llm.common import stage_path  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 511, 512, 513, 5000])
def test_codes_round_trip_and_random_access(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, rng.choice([200, 300, 70_000, 2**32 - 1], n) + 1).astype(np.uint32) if n else np.empty(0, np.uint32)
    codes = t.Codes(t.pack(ids))
    assert codes.n == n and (codes.slice(0, n) == ids).all()
    for i in rng.integers(0, n, 60) if n else []:
        assert codes[int(i)] == ids[i]
        j = int(rng.integers(i, n))
        assert (codes.slice(int(i), j) == ids[i:j]).all()


def expected(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("segment", [10, 1 << 20])
def test_files_equal_library(spark, segment):
    texts = [None, "", " \t\n\x0b\x0c\r ", "a\x0bb\x0cc\rd", "It's  WE'LL 're\n'S x" * 9, "nb sp 　wide\u0085nel\x1cfs", "ÉÄ Σς İ é combining", "<|endoftext|> b", "foo <|endoftext|> bar<|endoftext|>baz <|STARTOFTEXT|>", "c'est l'ÉTÉ, d'où: 3x4=12…!! (l'œuvre) co-op'll 'S's ½ª#µ²", "İſ Ⱥ ß", "日本語 \U0001f600" * 50, "x\ue000y \ue000 \ue001z", "long" * 3000, "w " * 5000]
    rows = [(10 * i, x, "c") for i, x in enumerate(texts)] + [(20, "tie b", "c"), (20, "tie a", "c"), (20, "tie a", "c"), (None, "no id", "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start string").repartition(5)
    path = stage_path(spark, "test")
    t.write_tokens(docs, PATH, path, segment=segment)
    got = sorted(tuple(r) for r in t.read_tokens(spark, path).collect())
    assert got == sorted(expected([r[:2] for r in rows]))


def test_empty_table(spark):
    path = stage_path(spark, "test")
    t.write_tokens(spark.createDataFrame([], "doc_id bigint, text string"), PATH, path)
    assert t.read_tokens(spark, path).collect() == []
