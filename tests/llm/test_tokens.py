"""Token counts against the library itself, text by text."""

import random

import public_tokenizers
import pytest
from opsframe.llm import tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


def counted(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(df, MODEL).collect())


def expected(rows, library):
    return sorted((-1 if i is None else i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in rows)


def test_counts_of_odd_texts_and_repeated_rows(docs, rows, library):
    assert counted(docs) == expected(rows, library)


def test_counts_of_blanks_line_ends_and_special_strings(shipped, library):
    r = random.Random(3)
    signs = ["a", "b ", " ", "  ", "\n", "▁", "\t", "\r", "\x00", "é", "é", "À", "日本", "語", "<s>", "</s>", "<unk>", "<0x41>", "ﬁ", "①", "　", "the", "ing"]
    rows = [(i % 7 or None, "".join(r.choice(signs) for _ in range(r.randint(0, 30)))) for i in range(3000)]
    assert counted(shipped.createDataFrame(rows, "doc_id long, text string")) == expected(rows, library)


def test_long_texts_are_read_in_stretches(shipped, library, monkeypatch):
    r = random.Random(4)
    text = "".join(r.choice(["word", " ", "\n", "Zx9", "  é", "▁", "tion"]) for _ in range(900_000))
    assert len(text.encode()) > 2 << 20
    rows = [(1, text), (2, "x" * 70_000), (3, " " * 70_000), (4, text)]
    assert counted(shipped.createDataFrame(rows, "doc_id long, text string")) == expected(rows, library)
    import pyarrow as pa

    some = [text[i * 97:i * 97 + 40] for i in range(400)]
    column = pa.array([" " + t.replace("▁", " ") if t else "" for t in some])
    for size in (1, 2, 13):
        monkeypatch.setattr(tokens, "STRETCH", size)
        assert tokens.tokens_of(column, tokens.whole_tokens(MODEL)).tolist() == [len(library.encode(t)) for t in some]


def test_whole_tokens_are_those_that_encode_alone(library):
    counter = tokens.WholeTokens(MODEL)
    for string in random.Random(5).sample(sorted(counter.whole), 500):
        assert len(counter._encode([string])[0]) == 1 == counter.counts([string])[0]
    assert len(counter.whole) > 30_000


def test_forgotten_pre_tokens_are_counted_again(monkeypatch):
    counter = tokens.WholeTokens(MODEL)
    want = counter.counts([" qqzzq", " xyxyxyx", "wvwvw"])
    monkeypatch.setattr(tokens, "REMEMBERED", 1)
    for _ in range(3):
        assert (counter.counts([" qqzzq", "wvwvw", " xyxyxyx"]) == want[[0, 2, 1]]).all()


def test_text_ids_and_empty_tables(shipped, none, library):
    rows = [("x1", "one two"), (None, None), ("x1", "")]
    got = tokens.token_counts(shipped.createDataFrame(rows, "doc_id string, text string"), MODEL).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("None", 0), ("x1", 0), ("x1", len(library.encode("one two")))]
    assert tokens.token_counts(none, MODEL).count() == 0
