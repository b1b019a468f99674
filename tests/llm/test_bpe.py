import hashlib
import random

import public_tokenizers
import pytest
from skein.llm import bpe
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def both():
    reference = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    reference.no_truncation()
    reference.no_padding()
    return bpe.load(bpe.word_bpe()), reference


CASES = ["", " ", "a<|endoftext|>b", "<|startoftext|>", "x\x1cy", "ΑΣ ΟΔΟΣ", "İstanbul", "a" * 70, "Å x", "'s'T'Re don't we'LL", "a\x85b c​d﻿e", "日本語テスト", "1234 ½ ² ٣", "🙂🙃👩‍👩‍👧", "\x00a", "a ̈b", "the\nend\t."]


def check(both, text):
    own, reference = both
    ids = reference.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids, text
    written, decoded = own.written(text)
    assert written == " ".join(map(str, ids)) and decoded == reference.decode(ids, skip_special_tokens=False), text


@pytest.mark.parametrize("text", CASES)
def test_cases(both, text):
    check(both, text)


def test_random_texts(both):
    r = random.Random(5)
    for _ in range(1500):
        check(both, "".join(r.choice("aabcdeeth inganre'st ñéüß.") for _ in range(r.randint(1, 60))))
        check(both, "".join(chr(r.choice([r.randint(32, 126), r.randint(0xA0, 0x24F), r.randint(0x3B1, 0x3C9), r.randint(0x3041, 0x3090)])) for _ in range(r.randint(1, 20))))


def test_query_on_whole_documents(spark, sf, both, odd_docs, make_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for row in bpe.encode_table(docs, bpe.word_bpe(), outputs=("ids", "ids_sha256", "decoded_sha256")).collect():
        ids = both[1].encode(text[row.doc_id], add_special_tokens=False).ids
        written = " ".join(map(str, ids))
        assert row.n_tokens == len(ids) and row.ids == written and row.ids_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(both[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()
    rows = sorted(((r.doc_id or 0), r.n_tokens) for r in bpe.encode_table(odd_docs, bpe.word_bpe()).collect())
    assert len(rows) == 9 and (1, 0) in rows and rows.count((6, 1)) == 2
    assert bpe.encode_table(make_docs([]), bpe.word_bpe()).count() == 0


def test_words_that_share_prefixes(both):
    """Words in any order, with remembered prefixes, against the library."""
    r = random.Random(3)
    stems = ["".join(r.choice(["th", "er", "in", "keit", "é", "ñ", "of", "x", "ing", "🙂"]) for _ in range(r.randrange(1, 7))) for _ in range(300)]
    for s in stems:
        for _ in range(6):
            check(both, s[: r.randrange(1, len(s) + 1)] + r.choice(["", "s", "ing", "th", "e", "erst"]))
    assert both[0].prefixes
