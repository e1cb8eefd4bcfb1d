"""The digest operators against plain Python on odd texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from llm import brute
from opsframe.llm import contamination, lines, packing, passages, repeats, rules, secrets, winnowing
from pyspark.sql import functions as F

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def got(df, *columns):
    return sorted(tuple(r) for r in df.select("doc_id", *columns).collect())


def test_repeated_bytes(docs, rows):
    assert got(repeats.repeats(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.op3(rows))


def test_repeated_words(docs, rows):
    assert got(passages.without_passages(docs), "n_words", "n_removed", "kept_sha256") == sorted(brute.op10(rows))


def test_hot_fingerprints_are_split_with_equal_results(docs, rows, monkeypatch):
    monkeypatch.setattr(winnowing, "HOT", 1)
    assert got(repeats.repeats(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.op3(rows))
    assert got(passages.without_passages(docs), "n_words", "n_removed", "kept_sha256") == sorted(brute.op10(rows))


@pytest.mark.parametrize("seed", range(6))
def test_maximal_repeats(seed):
    r = np.random.default_rng(seed)
    texts = [bytes(r.integers(97, 99, r.integers(0, 60)).astype(np.uint8)) for _ in range(5)]
    texts += [texts[0], texts[1][5:50]]
    groups, spans = repeats.repeats_of_shard(texts, 16)
    want = brute.repeated(texts, 16)
    for s, hit in zip(spans, want):
        mine = bytearray(len(hit))
        for a, b in s:
            mine[a:b] = b"\1" * (b - a)
        assert mine == hit
    for size, found in groups:
        strings = {texts[t][p:p + size] for t, p in found}
        assert len(strings) == 1 and len(found) > 1
        every = {(t, p) for t, x in enumerate(texts) for p in range(len(x) - size + 1) if x[p:p + size] in strings}
        assert set(found) == every


def test_contamination(docs, rows, shipped, texts):
    words = texts[7][1].split()
    items = [(0, " ".join(words[100:130]).upper()), (1, " ".join(words[4000:4010])), (2, " ".join(words[50:54])), (3, None), (4, ""),
             (5, "never seen words of any document in here at all"), (0, " ".join(words[-12:])), (None, "two three"), (6, words[3])]
    bench = shipped.createDataFrame(items, "item_id long, text string")
    want = brute.op5(rows, [("" if i is None else i, t) for i, t in items])
    columns = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert got(contamination.contamination(docs, bench), *columns) == sorted(want)
    left = contamination.clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(w[0] for w in want if not w[5])


def test_line_dedup(docs, rows):
    found = lines.line_dedup(docs.dropDuplicates(["doc_id"])).withColumn("kept_sha256", F.sha2("kept", 256))
    assert got(found, "n_lines", "n_dropped", "kept_sha256") == sorted(brute.op9(rows[:-1]))
    left = lines.without_frequent_lines(docs)
    assert left.columns == docs.columns and left.count() == docs.count()
    assert all(r.n_chars == len(r.text or "") and (r._key, r.node) == ("k", 1) for r in left.collect())
    assert not left.where("lower(text) like '%shared footer%'").count()


def test_line_runs_keep_counts_through_merges(shipped):
    runs = lines.LineRuns(least=4, fanout=2)
    for batch in ([1, 2, 3], [1, 2], [1], [1, 3], [2, 3], [2]):
        runs.add(shipped.createDataFrame([(k, -k, 1) for k in batch], "h1 long, h2 long, n long"))
    assert sorted(r.h1 for r in runs.frequent().collect()) == [1, 2]


def test_rules(docs, rows):
    found = rules.judged(docs)
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert got(found, *columns) == sorted(brute.op7(rows))
    by = {r.doc_id: r for r in found.collect()}
    assert by[18].kept and not by[18].cleaned.startswith("home") and not by[0].kept


def test_secrets(docs, rows):
    found = secrets.digest(secrets.secrets(docs))
    assert got(found, "n_assign", "n_access", "n_hex", "base_sha256") == sorted(brute.op8(rows))
    spans = {r.doc_id: r.spans for r in found.collect()}
    assert "secret" in spans[16] and "identifier" in spans[16] and "secret" not in spans[17]


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    out = packing.packed(docs, TOKENIZER).collect()
    coder = Tokenizer.from_file(TOKENIZER)
    want = []
    for i, t in rows:
        ids = coder.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(i, p, p * 2048, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
                 for p, x in enumerate(ids[a:a + 2048] for a in range(0, len(ids), 2048))]
    assert sorted(tuple(r)[:5] for r in out) == sorted(want)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in out) // 2048) + 1


def test_empty_tables(none, shipped):
    bench = shipped.createDataFrame([], "item_id long, text string")
    for df in (repeats.repeats(none), passages.without_passages(none), contamination.contamination(none, bench), lines.line_dedup(none),
               rules.judged(none), secrets.digest(secrets.secrets(none)), packing.packed(none, TOKENIZER),
               lines.without_frequent_lines(none), contamination.clean(none, bench)):
        assert df.count() == 0
