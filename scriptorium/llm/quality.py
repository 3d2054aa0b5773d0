"""Quality rules on repetition: how much of a text lies in repeated lines and n-grams.

Rolling 64-bit hashes of the n-grams of a few lengths are compared within each
document. A repeated n-gram consists of repeated shorter ones, so each length
looks only where the length before it found repetition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.llm import text as tx

#: Largest share of a text's word characters that may lie in n-grams found twice or more, by n, and in lines equal to an earlier one.
GRAM_LIMITS = {5: 0.30, 7: 0.26, 10: 0.20}
LINE_LIMIT = 0.30
MIN_WORDS, REPEAT_PERCENT = 50, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("dup_line_chars", pa.int64())]
    + [(f"dup_{n}gram_chars", pa.int64()) for n in GRAM_LIMITS]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_())]
)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    return twice[np.minimum(at, len(twice) - 1)] == keys


def covered(n_words: int, first: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in the n-grams that begin at first."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + n, -1)
    return np.cumsum(step[:-1]) > 0


def _measure(chunk: tx.Chunk) -> dict:
    words, n = chunk.words, len(chunk)
    mark = tx.mix(np.arange(1, n + 1, dtype=np.uint64))
    by_doc = lambda flags, w=None: np.bincount(words.doc[flags], None if w is None else w[flags], n).astype(np.int64)
    code_points = np.concatenate([[0], np.cumsum((chunk.buf & 0xC0) != 0x80)])
    chars = code_points[words.ends] - code_points[words.starts]

    _, at = words.grams(3)
    found, repeats, length = {}, None, 3
    for size in (3, *GRAM_LIMITS):
        if repeats is not None:
            # all the shorter grams within must be repeated too
            run = np.zeros(len(words) + 1, np.int64)
            run[repeats] = 1
            run = np.concatenate([[0], np.cumsum(run)])
            inner = size - length + 1
            at = repeats[repeats + inner <= len(words)]
            at = at[(run[at + inner] - run[at] == inner) & (words.doc[at] == words.doc[np.minimum(at + size - 1, len(words) - 1)])]
            at = at[at + size <= len(words)]
        keys = tx.gram_hashes(words.hashes, at, size) ^ mark[words.doc[at]]
        repeats, length = at[repeated(keys)], size
        found[size] = covered(len(words), repeats, size)

    starts, ends, line_doc = chunk.lines
    full = np.searchsorted(words.starts, starts) < np.searchsorted(words.starts, ends)
    starts, ends, line_doc = starts[full], ends[full], line_doc[full]
    keys = tx.hash_spans(chunk.buf, starts, ends) ^ mark[line_doc]
    later = np.ones(len(keys), bool)
    later[np.unique(keys, return_index=True)[1]] = False
    dup = np.flatnonzero(later)
    word_chars = np.concatenate([[0], np.cumsum(chars)])
    line_chars = word_chars[np.searchsorted(words.starts, ends[dup])] - word_chars[np.searchsorted(words.starts, starts[dup])]

    out = {
        "doc_id": chunk.batch.column(0),
        "n_words": words.counts.astype(np.int64),
        "word_chars": np.bincount(words.doc, chars, n).astype(np.int64),
        "n_symbols": chunk.per_doc(_SYMBOL[chunk.buf]),
        "n_dup_lines": np.bincount(line_doc[dup], minlength=n).astype(np.int64),
        "n_repeat_words": by_doc(found[3]),
        "dup_line_chars": np.bincount(line_doc[dup], line_chars, n).astype(np.int64),
    }
    total = np.maximum(out["word_chars"], 1)
    good = out["dup_line_chars"] <= LINE_LIMIT * total
    for size, limit in GRAM_LIMITS.items():
        out[f"dup_{size}gram_chars"] = by_doc(found[size], chars)
        good &= out[f"dup_{size}gram_chars"] <= limit * total
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
    out["kept"] = good & ~out["base_failed"]
    return out


def repetition(docs: DataFrame) -> DataFrame:
    """Counts of words, symbols and repetition of each document, and whether it is kept.

    One row out for each row in, whole texts, no shuffle. A null text counts as
    an empty one, has no words and fails the word minimum. Null and repeated
    doc_ids pass through. Other columns are ignored; an empty table gives no
    rows.
    """
    return tx.map_chunks(tx.documents_of(docs), _measure, SCHEMA)
