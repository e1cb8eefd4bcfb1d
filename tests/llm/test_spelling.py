"""Spelling variants against brute force over all edits."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from opsframe.llm import spelling

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def brute(rows):
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}
    signs = sorted(set("".join(words)))
    near, form = {}, {}
    for w in words:
        found = {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + a + w[i + 1:] for i in range(len(w)) for a in signs}
        found |= {w[:i] + a + w[i:] for i in range(len(w) + 1) for a in signs}
        near[w] = [x for x in found - {w} if x in words]
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words)


def got(df):
    return sorted(tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.fixture(scope="module")
def rows():
    """Words of few letters, many of them near, some in chains of forms; runs of equal letters; letters beyond ASCII."""
    r = random.Random(8)
    common = ["".join(r.choice("aabé") for _ in range(r.randint(7, 9))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "ab" * 5, "abab" * 9, "×÷ÀÿÀÿÀ"]
    out = [(None, None), (None, ""), (7, "nothing else"), (None, "chained chained CHAINED")]
    for i in range(150):
        text = []
        for _ in range(40):
            w = r.choice(common)
            p = r.randrange(len(w))
            edit = r.random()
            w = w[:p] + w[p + 1:] if edit < 0.1 else w[:p] + r.choice("abéÖ") + w[p + (edit < 0.2):] if edit < 0.3 else w
            text.append(w.upper() if r.random() < 0.1 and w.isascii() else w)
        out.append((i % 60 or None, r.choice([" ", "\n", "1", "ß", "-"]).join(text)))
    for n, w in ((2, "zzzabcd"), (30, "zzzabce"), (400, "zzzabcef"), (4500, "zzzabcefg"), (30, "zzzabcg")):
        out += [(1000, f"{w} " * n)]
    return out + [out[9]]


def test_variants_equal_brute_force(shipped, rows):
    df = shipped.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], "doc_id long, text string, n int, word string, id int, form int").repartition(5)
    want = brute(rows)
    assert sum(w[1] is not None for w in want) > 10 and any(w[2] not in (w[0], w[1]) for w in want)
    assert got(df) == want


def test_more_ranges_than_words(shipped, rows):
    few = [(i, t) for i, t in rows if t and "zzz" in t] + [(None, "prefixed prefixedlonger prefixe"), (None, "prefixed prefixedlonger prefixe")]
    shipped.conf.set("spark.sql.shuffle.partitions", "13")
    shipped.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(shipped.createDataFrame(few, "doc_id long, text string")) == brute(few)
    finally:
        shipped.conf.set("spark.sql.shuffle.partitions", "4")
        shipped.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ranges_take_over_the_path_before_them():
    words = sorted({"".join(p) for p in [random.Random(i).choices("ab", k=random.Random(i).randint(1, 6)) for i in range(200)]})
    for cuts in ([5, 6, 7, 40], [1], [], [20, 21, 22, 23, 24]):
        ends, paths = [], []
        for part, some in enumerate(np.split(np.array(words, object), cuts)):
            before, path, count = "", [], 0
            for i, w in enumerate(some):
                keep = spelling.shared(before, w) + 1 if path else 0
                path = path[:keep] + [(part << spelling.PART_BITS) + count + j for j in range(len(w) + 1 - keep)]
                count, before = count + len(w) + 1 - keep, w
                paths.append((w, np.array(path)))
                edge = (i == 0) + 2 * (i + 1 == len(some))
                if edge:
                    ends.append((part, edge, w, np.array(path)))
        over = spelling.taken_over(ends)
        node = {}
        for w, path in paths:
            for i, x in enumerate(spelling.renumbered(path, over).tolist()):
                assert node.setdefault(w[:i], x) == x
        assert len(set(node.values())) == len(node)
        last = [spelling.renumbered(p, over)[-1] for _, p in paths]
        assert last == sorted(last)


def test_long_texts_are_read_in_stretches(shipped):
    r = random.Random(2)
    text = " ".join(r.choice(["longwords", "longwordz", "MIDDLING", "x", "a" * 300]) for _ in range(60_000))
    assert len(text) > 2 << 20
    assert sorted(sum(spelling.runs(text, 1000), [])) == sorted(re.findall("[a-z]{7,}", text.translate(LOWER)))
    rows = [(1, text), (2, "b" * 5000 + " " + "b" * 5000)]
    assert got(shipped.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_tables_without_words(shipped, none):
    assert got(none) == []
    assert got(shipped.createDataFrame([(1, None), (2, "single appearance"), (None, "short is short is")], "doc_id long, text string")) == []
