import hashlib

import numpy as np
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from cohortry.llm import bpe

PATH = bpe.vocabulary_path()
LIBRARY = Tokenizer.from_file(PATH)


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    back = LIBRARY.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def check(docs):
    got = bpe.encode_documents(docs).collect()
    want = docs.select("doc_id", "text").collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted((r.doc_id or -1, *expected(r.text)) for r in want)


def test_equals_the_library(docs, sample):
    check(docs)
    check(sample)


def test_empty_table(no_docs):
    assert bpe.encode_documents(no_docs).count() == 0


def test_shared_chunks_are_joined(spark):
    body = " ".join(f"tok{i * 7919 % 1000}'s  {i}" for i in range(3000))
    docs = spark.createDataFrame([(i, f"{i} head {body} tail{i}") for i in range(6)], "doc_id long, text string")
    check(docs)


def test_round_trip(docs):
    texts = bpe.decode_documents(bpe.encode_documents(docs))
    assert sorted((r.doc_id or -1, r.text) for r in texts.collect()) == sorted((r.doc_id or -1, r.text or "") for r in docs.select("doc_id", "text").collect())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab '\n\t09é漢.<|>endoftext"), max_size=400), st.integers(1, 40))
def test_repair_of_any_joint(text, step):
    codec = bpe.codec_of(PATH)
    parts = [codec.encode(text[i:i + step]) for i in range(0, len(text), step)]
    assert bpe.repair(codec, parts).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=300))
def test_codec_on_any_text(text):
    codec = bpe.codec_of(PATH)
    assert codec.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_cuts_cover_the_text_and_follow_content():
    data = np.random.default_rng(1).integers(97, 123, 20_000).astype(np.uint8).tobytes()
    ends = bpe.cuts(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends))
    moved = {e - 5 for e in bpe.cuts(b"12345" + data)}
    assert len(moved & set(ends)) > 0.8 * len(ends)
