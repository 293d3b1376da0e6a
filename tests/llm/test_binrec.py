import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from recordmill.llm import binrec
from recordmill.llm.common import shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip_equals_the_tokenizer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = shared_dir(spark)
    index = binrec.write(docs.repartition(5), folder, PATH)
    tokenizer, start, want = Tokenizer.from_file(PATH), 0, {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in binrec.read_back(spark, folder).collect()} == want
    for r in index.orderBy("length").limit(5).collect():
        doc_id, ids = binrec.fetch(folder, r.file, r.offset)
        assert doc_id == r.doc_id and len(ids) == want[doc_id][1]


def test_words_in_a_cache_give_what_whole_texts_give():
    texts = [
        "It's ÉTÉ. don't  I'M  we'Ll x y İ ΣΑΣ. ς é. A\x1cb 12,345.6 !!! a... <|endoftext|> <|ENDOFTEXT|>. x<|endoftext|>y",
        "́accent at the start", "漢字。 かな", "Straße STRASSE ﬁ Ω K", None, "", " \n\t ", "'s 't THE THE. the, The;",
    ]
    ids, tokenizer = binrec.WordIds(PATH), Tokenizer.from_file(PATH)
    for got, t in zip(ids.encode(texts), texts):
        assert np.frombuffer(got, "<u2").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_damage_is_found():
    good = binrec.frame(b"some payload") + binrec.frame(b"")
    assert list(binrec.frames(io.BytesIO(good))) == [b"some payload", b""]
    for k in range(len(good)):
        broken = good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :]
        with pytest.raises(ValueError):
            list(binrec.frames(io.BytesIO(broken)))
    with pytest.raises(ValueError):
        list(binrec.frames(io.BytesIO(good[:-1])))


def test_odd_texts(spark, odd, nothing):
    folder = shared_dir(spark)
    binrec.write(odd, folder, PATH)
    rows = sorted(binrec.read_back(spark, folder).collect(), key=lambda r: r.start)
    assert len(rows) == 11 and rows[0].doc_id is None
    assert [r.doc_id for r in rows[1:]] == sorted(r.doc_id for r in rows[1:])
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    empty = shared_dir(spark)
    binrec.write(nothing, empty, PATH)
    assert binrec.read_back(spark, empty).count() == 0
