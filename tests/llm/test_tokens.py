"""Token id files: exact round trips."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SF_SMALL
from kindsort.llm import tokens
from kindsort.llm.queries import TOKENIZER, op8_token_ids

SCHEMA = "doc_id long, text string"
PLAIN = Tokenizer.from_file(TOKENIZER)


def plain_ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 0]


def expected(rows):
    """[(key, start, ids, crc)] of the contract."""
    out, start = [], 0
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = plain_ids(t)
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in df.collect()), key=lambda r: r[1])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 62), max_size=600))
def test_elias_fano(values):
    values = sorted(values)
    ef = tokens.EliasFano.of(np.array(values, np.uint64))
    head, data = ef.parts()
    back = tokens.EliasFano.read(head, data)
    assert back.all().tolist() == values
    assert [back.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 900, 100_000)).astype(np.uint64)
    _, data = tokens.EliasFano.of(ends).parts()
    assert len(data) * 8 < 11.5 * len(ends)  # 2 + log2(450) bits a document, where a table takes 64


PARTS = st.sampled_from([" ", "  ", "\n", "\n\n", "\t", " \n", "\n ", "a", "Word", " word", "'s", "'", "é", "123", "!!", "<|endoftext|>", " ", " ", "\x1c", "Ġ", "漢字", "_", ".", ",", "a.\nB", "x\ny", "\r\n", "Élan", " ßé.", "a,", "x\nÿé!", "don't", "\u0590", "\ud7ff"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=30).map("".join))
def test_encoder_is_the_tokenizer(text):
    enc = tokens.encoder(TOKENIZER)
    ids = enc.encode(text)
    assert np.frombuffer(ids, enc.kind).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_encoder_on_any_text(text):
    enc = tokens.encoder(TOKENIZER)
    assert np.frombuffer(enc.encode(text), enc.kind).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_encoder_memo_forgets():
    enc = tokens.Encoder(TOKENIZER, memo=20)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcé,") for _ in range(rng.randint(1, 6))) for _ in range(30)) for _ in range(20)]
    for t in texts + texts:
        assert np.frombuffer(enc.encode(t), enc.kind).tolist() == PLAIN.encode(t, add_special_tokens=False).ids


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert got(op8_token_ids(spark, SF_SMALL)) == expected(rows)


@pytest.mark.parametrize("shards", (1, 7))
def test_odd_rows(make, shards, tmp_path):
    rows = [(5, "b"), (None, "x"), (None, None), (-(1 << 63), "low"), ((1 << 63) - 1, "high"), (5, "b"), (0, ""), (7, None), (9, "long " * 100_000)]
    df = make(rows, SCHEMA).selectExpr("*", "1 as start", "2 as key").repartition(4)
    tokens.write_ids(df, str(tmp_path / "ids"), TOKENIZER, shards=shards)
    assert got(tokens.read_ids(df.sparkSession, str(tmp_path / "ids"))) == expected(rows)


def test_any_document_by_select(make, spark, tmp_path):
    rows = [(i * 3, f"text {i} " * (i % 50)) for i in range(700)]
    manifest = tokens.write_ids(make(rows, SCHEMA), str(tmp_path / "ids"), TOKENIZER, shards=2).collect()
    assert sum(r["docs"] for r in manifest) == len(rows)
    for r in manifest:
        shard = tokens.Shard(str(tmp_path / "ids"), r["file"])
        for i in (0, 1, 255, 256, 257, r["docs"] - 1):
            assert shard.document(i).tolist() == plain_ids(rows[(shard.keys.select(i) + shard.head["smallest"]) // 3][1])


def test_empty_table(make):
    assert got(tokens.encode_documents(make([], SCHEMA), TOKENIZER)) == []


def test_a_key_on_most_rows_fills_several_shards(make, tmp_path):
    rows = [(7, f"t{i} words") for i in range(400)] + [(None, f"n{i}") for i in range(200)] + [(i, "x y") for i in range(30)]
    made = tokens.write_ids(make(rows, SCHEMA).repartition(5), str(tmp_path / "ids"), TOKENIZER, shards=8).collect()
    assert len(made) >= 6 and max(m["docs"] for m in made) < 250
    assert got(tokens.encode_documents(make(rows, SCHEMA), TOKENIZER)) == expected(rows)
