"""Line-first cleaning, in DataFrame functions only.

Words are runs of anything but the six ASCII white space characters. Each line with a word is judged by itself; lines
that fail leave the text; a document is kept if it passes the base rules and keeps enough of its word characters.

Line rules (a line fails by any of them):
  punctuation  most of its words carry a symbol of #*$%&|<>, or end in "!!"
  navigation   three words or more of which a third or more are bare separators
  boilerplate  it matches a phrase of `BOILERPLATE`
  repetition   eight words or more, fewer than a quarter of them different

A null text has no words, fails the base rules and is not kept. Rows that repeat a document are judged each by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.store import let

SYMBOLS = "#*$%&|<>"
SPACE = "[ \\t\\n\\x0B\\f\\r]+"
#: Phrases that only frame a page; a line that consists of little else fails.
BOILERPLATE = (r"(?i)^\s*(all rights reserved|copyright (\(c\)|©)|cookie policy|privacy policy|terms of (use|service)|"
               r"log ?in|sign ?up|subscribe|click here|read more|home \| about)\b.{0,60}$")
LEAST_WORDS = 50
LEAST_KEPT = 0.5


def _words(text):
    return F.filter(F.split(text, SPACE), lambda w: F.length(w) > 0)


def _share(words, test):
    return F.size(F.filter(words, test)) / F.size(words)


def _line_fails(line):
    def judge(words):
        n = F.size(words)
        punctuation = _share(words, lambda w: w.rlike("[#*$%&|<>]|!!$")) > 0.5
        navigation = (n >= 3) & (_share(words, lambda w: w.rlike("^[|>»•·/-]+$")) >= 0.3)
        repetition = (n >= 8) & (F.size(F.array_distinct(words)) * 4 < n)
        return (n > 0) & (punctuation | navigation | repetition | line.rlike(BOILERPLATE))
    return let(_words(line), judge)


def _symbols(text):
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def _repeated(words):
    """Words in 3-word windows that occur twice or more in the text."""
    n = F.size(words)
    after = F.slice(words, 2, F.greatest(n - 1, F.lit(0)))
    last = F.slice(words, 3, F.greatest(n - 2, F.lit(0)))
    grams = F.slice(F.zip_with(F.zip_with(words, after, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), last,
                               lambda x, c: F.xxhash64(x["a"], x["b"], c)), 1, F.greatest(n - 2, F.lit(0)))
    placed = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def cover(sorted_grams):
        twice = F.filter(F.transform(sorted_grams, lambda x, j: F.when(
            (F.get(sorted_grams, j - 1)["h"] == x["h"]) | (F.get(sorted_grams, j + 1)["h"] == x["h"]), x["i"])),
            lambda i: i.isNotNull())
        return F.aggregate(F.array_sort(twice), F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n")),
                           lambda s, i: F.struct(i.alias("at"), (s["n"] + F.least(F.lit(3), i - s["at"])).cast("long").alias("n")))["n"]

    return let(placed, cover)


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and cleaned: the text without the lines that fail."""
    docs = documents.select(documents["doc_id"].alias("doc_id"),
                            F.coalesce(documents["text"].cast("string"), F.lit("")).alias("text"))

    def counts(words):
        total = F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w))
        return F.struct(F.size(words).cast("long").alias("n_words"), total.alias("word_chars"), _repeated(words).alias("n_repeat_words"))

    def lines(every):
        worded = F.filter(every, lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
        kept = F.filter(every, lambda x: ~_line_fails(x))
        twice = let(worded, lambda some: (F.size(some) - F.size(F.array_distinct(some))).cast("long"))
        return F.struct(twice.alias("n_dup_lines"), F.array_join(kept, "\n").alias("cleaned"))

    found = docs.select("doc_id", let(_words(F.col("text")), counts).alias("c"), _symbols(F.col("text")).alias("n_symbols"),
                        let(F.split("text", "\n", -1), lines).alias("l"))
    found = found.select("doc_id", "c.n_words", "c.word_chars", "n_symbols", "l.n_dup_lines", "c.n_repeat_words", "l.cleaned")
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.length(F.regexp_replace("cleaned", SPACE, "")) >= LEAST_KEPT * F.col("word_chars")
    return found.withColumn("base_failed", base).withColumn("kept", ~base & left)


#: DuckDB; the base counts, with the line rules as above.
def rules_sql() -> str:
    """DuckDB SQL of `judged` without `cleaned`."""
    worded = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '{worded}')) AS w,
             unnest(range(len(regexp_extract_all(text, '{worded}')))) AS i FROM d),
g AS (SELECT doc_id, i, w, concat_ws(' ', w, lead(w) OVER (PARTITION BY doc_id ORDER BY i), lead(w, 2) OVER (PARTITION BY doc_id ORDER BY i)) AS gram,
             lead(w, 2) OVER (PARTITION BY doc_id ORDER BY i) IS NOT NULL AS whole FROM w),
t AS (SELECT doc_id, i, w, whole AND count(*) OVER (PARTITION BY doc_id, gram, whole) > 1 AS twice FROM g),
r AS (SELECT doc_id, w, coalesce(twice OR lag(twice) OVER (PARTITION BY doc_id ORDER BY i) OR lag(twice, 2) OVER (PARTITION BY doc_id ORDER BY i), false) AS hit FROM t),
c AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars, count(*) FILTER (WHERE hit) AS n_repeat_words FROM r GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (SELECT doc_id, line, regexp_extract_all(line, '{worded}') AS ws FROM l WHERE regexp_matches(line, '{worded}')),
j AS (SELECT doc_id, line, len(array_to_string(ws, '')) AS chars,
             len(list_filter(ws, x -> regexp_matches(x, '[#*$%&|<>]|!!$'))) > 0.5 * len(ws)
             OR len(ws) >= 3 AND len(list_filter(ws, x -> regexp_matches(x, '^[|>»•·/-]+$'))) / len(ws) >= 0.3
             OR len(ws) >= 8 AND len(list_distinct(ws)) * 4 < len(ws)
             OR regexp_matches(line, '{BOILERPLATE}') AS bad FROM k),
s AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE NOT bad), 0) AS kept_chars FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
       length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
       coalesce(n_repeat_words, 0) AS n_repeat_words,
       coalesce(n_words, 0) < {LEAST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > 50 * coalesce(n_words, 0) AS base_failed,
       NOT (coalesce(n_words, 0) < {LEAST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > 50 * coalesce(n_words, 0))
       AND coalesce(kept_chars, 0) >= {LEAST_KEPT} * coalesce(word_chars, 0) AS kept
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
