import zlib

import numpy as np
from tokenizers import Tokenizer

from stackmill.llm import dac, token_output as O

TEXTS = [None, "", "  ", "Don't STOP, he's 3.5% <|endoftext|> é ΑΣ Σ. x,y. A,", "Ünï cödé <|ENDOFTEXT|> ...,, ,.", "word " * 30_000, "same", "same"]


def test_dac_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 4000):
        for top in (200, 60_000, 2**40):
            ids = rng.integers(0, top, n).astype(np.uint64)
            codes = dac.Codes(dac.encode(ids))
            at = rng.integers(0, max(n, 1), 40)[:n]
            assert (codes.slice(0, n) == ids).all() and (codes.take(at) == ids[at]).all() and (codes.slice(n // 3, n // 2) == ids[n // 3 : n // 2]).all()


def test_documents_read_back(spark, docs_of):
    tokenizer = Tokenizer.from_file(O.default_tokenizer())
    docs = docs_of(TEXTS, ids=[5, 3, 9, 1, 2, 8, 7, 7])
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in O.token_table(spark, docs).collect())
    want, at = [], 0
    for doc, text in sorted(zip([5, 3, 9, 1, 2, 8, 7, 7], TEXTS), key=lambda x: x[0]):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_random_access_and_empty(spark, docs_of, tmp_path):
    path = f"file://{tmp_path}/tokens"
    O.write_tokens(docs_of(TEXTS), O.default_tokenizer(), path)
    tokenizer = Tokenizer.from_file(O.default_tokenizer())
    ids = [x for t in TEXTS for x in tokenizer.encode(t or "", add_special_tokens=False).ids + [2]]
    places = [0, 1, 5, 17, 300, len(ids) - 1]
    asked = spark.createDataFrame([(p,) for p in places], "place long")
    assert {r["place"]: r["id"] for r in O.read_tokens(spark, path, asked).collect()} == {p: ids[p] for p in places}
    assert O.token_table(spark, docs_of(TEXTS).limit(0)).count() == 0


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(O, "CACHE", 3)
    e = O.PieceEncoder(O.default_tokenizer())
    text = b"a b c d e f g a b c A. b, a"
    whole = np.array(e.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
    assert e.encode(text) == whole and e.encode(text) == whole and len(e) <= 3
