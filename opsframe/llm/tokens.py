"""Token counts of whole texts for a sentencepiece BPE model, by the whole-token shortcut.

The encoder starts from single characters and joins neighbours whose union is a vocabulary string. So it never joins two
characters that stand side by side in no vocabulary string, and what lies on either side of them is encoded on its own.
`WholeTokens` reads the vocabulary once per worker and proves three things, or refuses the model:

  * nothing is left of a blank but blanks, and a line end stands in no vocabulary string: a text parts into pre-tokens,
    a line end or blanks with the characters after them, and its count is the sum of theirs;
  * texts reach the encoder as they are, with one blank in front of those that aren't empty (probes of the normaliser);
  * which vocabulary strings, encoded alone, are one token: pre-tokens equal to one of them count 1 without a merge.

Only the other pre-tokens are merged, by the library itself, each once per worker while it is remembered.

Null and empty texts have no bytes and no tokens. Texts of any length are read in stretches of about STRETCH bytes, cut
between pre-tokens; a pre-token itself is encoded whole. Rows that repeat are counted each, a null id stays null, other
columns don't matter, and an empty table gives no rows. Special strings in a text are ordinary characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.text import parts

BLANK = "▁"  # how the encoder writes a blank; as a character of a text it means the same
LIMIT = 4096
STRETCH = 8 << 20
REMEMBERED = 1_000_000  # pre-tokens of at most LONGEST characters, some 120 MB
LONGEST = 64
PROBES = ["a  b", " a", "a ", "ﬁ Ａ 　x", "ééÅ", "A\tb\r\nC\x00d\x7f", "<s>a</s><unk>", "<0x41>"]


class WholeTokens:
    """Counts of pre-tokens; those that are one vocabulary string of one token are known from the start."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        plain = {i: self.model.id_to_piece(i) for i in ids if not (
            self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))}
        inner = [p for p in plain.values() if BLANK in p.lstrip(BLANK) or "\n" in p]
        changed = [t for t in PROBES if self.model.normalize(t) != BLANK + t.replace(" ", BLANK)]
        if inner or changed or not self.model.is_byte(self.model.piece_to_id("<0x0A>")):
            raise ValueError(f"pre-tokens of this model aren't independent: strings {inner[:3]}, normalised texts {changed[:3]}")
        strings = [p.replace(BLANK, " ") for p in plain.values()]
        self.whole = {s: 1 for (s, i), found in zip(zip(strings, plain), self._encode(strings)) if found == [i]} | {"\n": 1}
        self.known = dict(self.whole)

    def _encode(self, pre_tokens: list[str]) -> list[list[int]]:
        """Ids of pre-tokens alone. The encoder puts a blank in front: it stands for a pre-token's own first blank, or it
        and a line end, which joins with nothing, are encoded in front and taken off again."""
        led = [p[:1] == " " and p != " " for p in pre_tokens]
        front = len(self.model.encode("\n"))
        found = self.model.encode([p[1:] if own else "\n" + p for p, own in zip(pre_tokens, led)], num_threads=1)
        return [ids if own else ids[front:] for ids, own in zip(found, led)]

    def counts(self, pre_tokens: list[str]) -> np.ndarray:
        """The tokens of each of some different pre-tokens."""
        found = [self.known.get(p, 0) for p in pre_tokens]
        new = [i for i, n in enumerate(found) if not n]
        if new:
            counted = list(map(len, self._encode([pre_tokens[i] for i in new])))
            if len(self.known) + len(new) > REMEMBERED:
                self.known = dict(self.whole)
            for i, n in zip(new, counted):
                found[i] = n
                if len(pre_tokens[i]) <= LONGEST:
                    self.known[pre_tokens[i]] = n
        return np.array(found, np.int64)


def begins(data: np.ndarray, before: int) -> np.ndarray:
    """Which bytes begin a pre-token, after a byte `before`, within one text."""
    previous = np.concatenate([np.array([before], np.uint8), data[:-1]])
    return (data == 0x0A) | (previous == 0x0A) | ((data == 0x20) & (previous != 0x20))


def tokens_of(column: pa.Array, counter: WholeTokens) -> np.ndarray:
    """The tokens of each text of a column without nulls, whose texts but for empty ones begin with a blank."""
    data, offsets = parts(column)
    total, first = np.zeros(len(column), np.int64), 0
    while first < len(data):
        last, step = min(len(data), first + STRETCH), 1 << 16
        while last < len(data) and not (found := np.flatnonzero(begins(data[last:last + step], data[last - 1]))).size:
            last += step
        if last < len(data):
            last += int(found[0])
        last = min(last, len(data))
        stretch = data[first:last]
        start = begins(stretch, 0x0A)
        inner = offsets[(offsets > first) & (offsets < last)] - first
        start[inner] = True
        start = np.flatnonzero(start)
        ends = np.append(start, len(stretch)).astype(np.int32)
        each = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends.tobytes()), pa.py_buffer(stretch.tobytes())).dictionary_encode()
        n = counter.counts(each.dictionary.to_pylist())[each.indices.to_numpy()]
        total += np.bincount(np.searchsorted(offsets, start + first, "right") - 1, n, len(total)).astype(np.int64)
        first = last
    return total


_models: dict[str, WholeTokens] = {}


def whole_tokens(path: str) -> WholeTokens:
    if path not in _models:
        _models[path] = WholeTokens(path)
    return _models[path]


def token_counts(documents: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row, whose tokens are more than `limit` where over_limit is set."""
    text = F.coalesce(documents["text"].cast("string"), F.lit(""))
    docs = documents.select(documents["doc_id"].alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.when(
        text == "", "").otherwise(F.concat(F.lit(" "), F.replace(text, F.lit(BLANK), F.lit(" ")))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = whole_tokens(model)
        for batch in batches:
            n = tokens_of(batch.column(2), counter)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(n > limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
