"""Token files against the library's own encoding of whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from burstlake.llm import token_files
from burstlake.llm.token_files import Encoder, TokenFiles, read_tokens, write_tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, ids string, start string"
LIBRARY = Tokenizer.from_file(WORDS)


def whole(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def enc():
    return Encoder(WORDS)


TRICKY = "aAzÉéßÿµªº0٣²'sStTrReEvVmMlLdD.,!<|startoftext|> \t\n\r\x0b\x0c\x1c\x1f\x85\xa0  ́̊ÅΣςİıǅ中文🙂é"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(TRICKY), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_pieces_equal_whole_texts(text):
    enc = test_pieces_equal_whole_texts.enc
    assert np.frombuffer(enc(text), enc.dtype).tolist() == whole(text)


test_pieces_equal_whole_texts.enc = Encoder(WORDS)


@pytest.mark.parametrize("text", ["it's I'M we'll'd 'sx ..'s", "<|startoftext|> a<|endoftext|>b <| x", "a" * 3000, "İstanbul ΑΣ ΑΣ.", "x" + "́" * 50 + " ́y", "1234 5²6 ٣٤", "\x1c\x1d a\x1cb \x00"])
def test_odd_words(enc, text):
    assert np.frombuffer(enc(text), enc.dtype).tolist() == whole(text)


def test_slices_and_full_tables(monkeypatch):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdeé'!1中 ") for _ in range(rng.randint(1, 9))) for _ in range(4000))
    monkeypatch.setattr(token_files, "SLICE", 100)
    monkeypatch.setattr(token_files, "PIECES", 50)
    monkeypatch.setattr(token_files, "ODD_WORDS", 20)
    enc = Encoder(WORDS)
    assert np.frombuffer(enc(text), enc.dtype).tolist() == whole(text)
    assert len(enc.odd) <= 200 and len(list(token_files.slices(text))) > 50


def brute(rows, library, end):
    out, start = [], 0
    for name, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((name, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("vocabulary", [WORDS, BYTES])
def test_files_equal_brute_force(spark, vocabulary):
    rng = random.Random(2)
    texts = [(k * 5 % 301, " ".join("".join(rng.choice("abcdeÉß'1!") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 30)))) for k in range(301)]
    texts += [(1000, None), (1001, ""), (1002, " \n"), (1003, "word " * 60000), (-5, "before zero"), (None, "no id")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in texts], DOCS).repartition(5)
    path = write_tokens(df, vocabulary, end_id=1)
    got = [tuple(r) for r in read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()]
    want = brute(sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0)), Tokenizer.from_file(vocabulary), 1)
    assert sorted(got, key=lambda r: r[1]) == want
    files = TokenFiles(path)
    assert len(files) == len(texts) and files.dtype == "<u2"
    flat = np.concatenate([files[k] for k in range(len(files))])
    assert [zlib.crc32(files[k].astype("<u4").tobytes()) for k in range(len(files))] == [r[3] for r in want]
    assert np.array_equal(files.window(0, 1 << 40), flat) and np.array_equal(files.window(len(flat) - 7, 100), flat[-7:])
    a = want[len(want) // 2][1]
    assert np.array_equal(files.window(a - 50, 100), flat[a - 50 : a + 50])
    with pytest.raises(IndexError):
        files[len(texts)]


def test_empty_repeated_and_hot_ids(spark):
    none = write_tokens(spark.createDataFrame([], DOCS), WORDS, end_id=1)
    assert read_tokens(spark, none).count() == 0 and len(TokenFiles(none)) == 0 and len(TokenFiles(none).window(0, 5)) == 0
    many = [(7, "same text again", "", "")] * 4000 + [(7, f"text {k}", "", "") for k in range(40)] + [(k, "x y", "", "") for k in range(200)]
    df = spark.createDataFrame(many, DOCS).repartition(6)
    path = write_tokens(df, WORDS, end_id=1)
    got = sorted((tuple(r) for r in read_tokens(spark, path).drop("ids").collect()), key=lambda r: r[1])
    assert len(got) == len(many) and [r[0] for r in got] == sorted(r[0] for r in many)
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    again = write_tokens(df.repartition(3), WORDS, end_id=1)
    one, two = TokenFiles(path), TokenFiles(again)
    assert np.array_equal(one.window(0, one.ids), two.window(0, two.ids))


def test_replace_and_refuse(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", "", "")], DOCS)
    path = write_tokens(df, WORDS, path=str(tmp_path / "t"))
    with pytest.raises(Exception, match="already"):
        write_tokens(df, WORDS, path=path)
    assert TokenFiles(path)[0].tolist() == whole("a b")
    token_files.encode(df.union(df), WORDS).write.format("token_files").option("dtype", "<u2").mode("overwrite").save(path)
    assert len(TokenFiles(path)) == 2 and len(list((tmp_path / "t").glob("*.ids"))) <= 2
    with pytest.raises(ValueError):
        TokenFiles(str(tmp_path))
