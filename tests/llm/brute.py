"""Plain Python versions of the digest queries, for small inputs: rows is a list of (doc_id, text)."""

import hashlib
import re
from collections import Counter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def repeated(sequences, length):
    """For each sequence, which units are covered by a window that starts anywhere else too."""
    seen = Counter(s[i:i + length] for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        hit = bytearray(len(s))
        for i in range(len(s) - length + 1):
            if seen[s[i:i + length]] > 1:
                hit[i:i + length] = b"\1" * length
        out.append(hit)
    return out


def op3(rows):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), t, hit in zip(rows, texts, repeated(texts, 400)):
        spans = sum(1 for j, h in enumerate(hit) if h and not (j and hit[j - 1]))
        out.append((i, len(t), sum(hit), spans, sha(bytes(b for b, h in zip(t, hit) if not h))))
    return out


def op10(rows):
    words = [tuple(SPACE.findall(t or "")) for _, t in rows]
    return [(i, len(w), sum(hit), sha(" ".join(x for x, h in zip(w, hit) if not h)))
            for (i, _), w, hit in zip(rows, words, repeated(words, 35))]


def op5(rows, items):
    windows = {}
    for item, text in items:
        w = LETTERS.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        w = LETTERS.findall((text or "").translate(LOWER))
        hit, met = [0] * len(w), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i:i + n])):
                    met |= found
                    hit[i:i + n] = [1] * n
        out.append((doc, len(w), sum(hit), len(met), sha(",".join(sorted(met))), sum(hit) > 0))
    return out


def op7(rows):
    out = []
    for doc, text in rows:
        w = SPACE.findall(text or "")
        grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        hit = [0] * len(w)
        for i in range(len(w) - 2):
            if grams[tuple(w[i:i + 3])] > 1:
                hit[i:i + 3] = [1, 1, 1]
        lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
        out.append((doc, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), sum(hit),
                    len(w) < 50 or 100 * sum(hit) > 50 * len(w)))
    return out


def op8(rows):
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = []
    for doc, text in rows:
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text or "") if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 16]
        n = Counter(s[1] for s in spans)
        kinds = ["assign", "access", "hex"]
        out.append((doc, n[0], n[1], n[2], sha(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans)))))
    return out


def op9(rows, least=10):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < least]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out
