"""Quality rules on repetition: characters inside duplicated n-grams and lines.

Words of several documents are coded together; a rolling hash over the codes
gives every n-gram of 5 to 10 words a 64-bit value that also holds its document,
so one sort per length finds what repeats within a document. A document fails
where words inside repeated n-grams, or repeated lines, hold too large a part of
its characters, or where the base rules fail it.

Nulls: a null text is empty, has no words and fails (fewer than 20 words). A
null doc_id is kept. Rows are judged one by one, so repeats and order do not
matter; an empty table gives an empty result; other columns are ignored. Long
texts are taken whole.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame

from weirline.llm.common import map_texts

#: Largest part of characters in words of n-grams found twice or more, first ones included.
MOST = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
MOST_LINES = 0.30
BASE_N, LEAST_WORDS, MOST_PERCENT = 8, 20, 30
SYMBOLS, SPACE = "#*$%&|<>", " \t\n\x0b\x0c\r"
PIECE = 4_000_000  # characters coded together

FIELDS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "base_failed": "boolean", "kept": "boolean", "dup_line_part": "double", "dup_ngram_parts": "array<double>",
}


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of whole numbers."""
    x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def repeated(values: np.ndarray) -> np.ndarray:
    """Positions whose value occurs twice or more."""
    s = np.sort(values)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.empty(0, dtype=np.int64)
    at = np.searchsorted(twice, values)
    at[at == len(twice)] = 0
    return np.flatnonzero(twice[at] == values)


def repetition(texts: list[str]) -> dict[str, np.ndarray]:
    """Counts and parts for each text."""
    code: defaultdict = defaultdict()
    code.default_factory = code.__len__
    ids, n_words = [], np.zeros(len(texts), dtype=np.int64)
    for k, t in enumerate(texts):
        words = t.encode("utf-8", "replace").split()
        n_words[k] = len(words)
        ids.append(np.fromiter(map(code.__getitem__, words), dtype=np.int64, count=len(words)))
    word = np.concatenate(ids) if ids else np.empty(0, dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), n_words)
    chars = np.fromiter((len(w.decode("utf-8", "replace")) for w in code), dtype=np.int64, count=len(code))[word]
    total = np.bincount(doc, weights=chars, minlength=len(texts))
    codes, salt = mixed(word), mixed(doc + (1 << 40))
    base = np.uint64(0x100000001B3 | 1)
    out = {"n_words": n_words, "word_chars": total.astype(np.int64)}
    roll, parts = codes, {}
    hits = np.arange(len(word))  # an n-gram can only repeat where its first n - 1 words do
    for n in range(2, max(MOST) + 1):
        roll = roll[:-1] * base + codes[n - 1 :] if len(roll) > 1 else roll[:0]
        if n < min(MOST):
            continue
        hits = hits[hits < len(roll)]
        hits = hits[doc[hits] == doc[hits + n - 1]]
        hits = hits[repeated(roll[hits] ^ salt[hits])]
        edge = np.zeros(len(word) + 1, dtype=np.int64)
        edge[hits] += 1
        edge[hits + n] -= 1
        inside = edge.cumsum()[:-1] > 0
        if n == BASE_N:
            out["n_repeat_words"] = np.bincount(doc[inside], minlength=len(texts)).astype(np.int64)
        if n in MOST:
            parts[n] = np.bincount(doc[inside], weights=chars[inside], minlength=len(texts)) / np.maximum(total, 1)
    out["parts"] = np.stack([parts[n] for n in sorted(MOST)], axis=1)
    return out


def line_counts(text: str) -> tuple[int, float]:
    """Lines with a word that equal an earlier line; their part of the characters of such lines."""
    if "\n" not in text:
        return 0, 0.0
    seen, again, chars, total = set(), 0, 0, 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            total += len(line)
            if line in seen:
                again += 1
                chars += len(line)
            else:
                seen.add(line)
    return again, chars / total if total else 0.0


def judged(texts: list[str]) -> dict:
    r = repetition(texts)
    lines = [line_counts(t) for t in texts]
    n_words, n_repeat = r["n_words"], r["n_repeat_words"]
    base_failed = (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_PERCENT * n_words)
    line_part = np.array([x[1] for x in lines], dtype=np.float64)
    passed = (r["parts"] <= np.array([MOST[n] for n in sorted(MOST)])).all(axis=1) & (line_part <= MOST_LINES)
    return {
        "n_words": n_words, "word_chars": r["word_chars"], "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
        "n_dup_lines": [x[0] for x in lines], "n_repeat_words": n_repeat, "base_failed": base_failed,
        "kept": ~base_failed & passed, "dup_line_part": line_part, "dup_ngram_parts": r["parts"].tolist(),
    }


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and the columns of FIELDS."""
    return map_texts(docs, ["doc_id"], ["text"], FIELDS, judged, PIECE)
