import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import DOCS, invented

from keyfold.llm import range_coder as R
from keyfold.llm import token_files as T
from keyfold.llm import tokens

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = ["", "a b", "a  b", " a", "a\nb  c\td", "x\x1cy z", "héllo's 123 <|endoftext|>x", "a \n b", "\x00 a", "a\x00b c", "a b c ", " ", "\n", "é ́x", "don't. stop, U.S. I.", "ǅ ß. ŉ,", "\x00. \x00a, a.", "A. a. A, ..", "日本。 語, ", "　x y\xa0z"]


@pytest.mark.parametrize("name", FILES)
def test_equals_the_library(name):
    e = tokens.Encoder(P.path(name))
    texts = ODD + invented(40) + ["word " * 30000]
    ids, n = e.encode(texts)
    want = [e.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("name", FILES)
def test_any_text_equals_the_library(name):
    e = tokens.encoder(P.path(name))

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t.,'sABCabc\x00́K")), max_size=30), max_size=4))
    def run(texts):
        ids, n = e.encode(texts)
        want = [e.tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]

    run()


def test_memory_may_be_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 50)
    e = tokens.Encoder(P.path(FILES[0]))
    for t in invented(20):
        assert e.encode([t])[0].tolist() == e.tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 255, 256, 700, 70_000])
@pytest.mark.parametrize("vocab", [2, 300, 50_000])
def test_blocks_round_trip(n, vocab):
    rng = np.random.default_rng(n + vocab)
    for ids in (rng.integers(0, vocab, n), rng.zipf(1.5, n) % vocab, np.full(n, vocab - 1), np.arange(n) // 50 % vocab):
        data = R.encode_block(ids.astype(np.uint32), vocab)
        assert np.array_equal(R.decode_block(data, vocab), ids)


def test_repeats_compress_and_damage_shows():
    ids = np.tile(np.random.default_rng(0).integers(0, 50_000, 100), 1000).astype(np.uint32)
    data = R.encode_block(ids, 50_000)
    assert len(data) < len(ids) // 4
    for at in (30, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            R.decode_block(bytes(bad), 50_000)


def test_files_round_trip(spark, monkeypatch):
    path = P.path(FILES[0])
    texts = invented(60) + [None, "", "same", "same", "long " * 20000]
    ids = [*range(59, -1, -1), 100, None, 70, 70, 65]
    schema = DOCS + ", k int, t string, id int, start int"
    df = spark.createDataFrame([(i, t, "en", "s", 0, 1, "t", 2, 3) for i, t in zip(ids, texts)], schema).repartition(4)
    got = T.read(spark, T.write(df, path, end_id=2)).collect()
    tok = tokens.encoder(path).tok
    rows = sorted(zip(ids, texts), key=lambda r: (r[0] is None, r[0] or 0))
    start, want = 0, []
    for i, t in rows:
        x = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_documents_across_blocks():
    class File(bytes):
        def size(self):
            return len(self)

        def read_at(self, n, at):
            return self[at : at + n]

    import io

    rng, out = np.random.default_rng(2), io.BytesIO()
    docs = [rng.integers(0, 900, n).astype(np.uint32) for n in (1, T.BLOCK - 1, 5, 2 * T.BLOCK + 7, 1, 3)]
    w = T.Writer(out, 900)
    for i, d in enumerate(docs):
        w.add([i], d, np.array([len(d)]))
    w.close()
    reader = T.Reader(File(out.getvalue()))
    crc = np.concatenate([c for _, _, c in reader.documents()])
    assert crc.tolist() == [zlib.crc32(d.tobytes()) for d in docs]


def test_empty_table(spark):
    assert T.read(spark, T.write(spark.createDataFrame([], DOCS), P.path(FILES[0]))).count() == 0


@pytest.mark.parametrize("name", FILES)
def test_pieces_met_again_stay(name):
    e = tokens.Encoder(P.path(name), memory=200)
    for k in range(30):
        text = "often met. Often, " + " ".join(f"once{chr(97 + k % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(60))
        assert e.encode([text])[0].tolist() == e.tok.encode(text, add_special_tokens=False).ids
        assert len(e.known) < 400
    e._age(100)
    assert "met." in e.known and len(e.known) <= 100
    assert e.encode(["x often met."])[0].tolist() == e.tok.encode("x often met.", add_special_tokens=False).ids


def test_the_next_stage_frees_the_encoders():
    from keyfold.llm.common import give_back

    mine = tokens.encoder(P.path(FILES[1]), 100)
    give_back(encoders=True)
    assert tokens.encoder(P.path(FILES[1])) is mine
    give_back()
    assert not tokens._ENCODERS
