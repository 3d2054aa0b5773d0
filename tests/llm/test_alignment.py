"""Groups and links of two tokenizers, against both run over whole texts and every pair of tokens."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from scriptorium.llm import alignment

ODD = ["", None, " ", "  a", "a ", "x ▁ y", "▁", "a  b\n c", "<|endoftext|> it's </s> <0x41> don't", "\x1c x \x85y é", "q" * 12_000, "\n\n\n", "naïve café 12 345", "日本 語 text", "a b"]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(public_tokenizers.path(alignment.VOCABULARY))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def spelled(tokenizers, text):
    """Ids and ends in bytes of both, or None."""
    a, b = tokenizers
    want = (" " + text).encode()
    byte = alignment._byte_of()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return None
    return ids_a, np.cumsum(list(map(len, bytes_a))).tolist(), ids_b, np.cumsum(list(map(len, bytes_b))).tolist()


def brute(tokenizers, rows):
    links, groups, sizes = [], [], []
    for _, text in rows:
        got = spelled(tokenizers, text or "")
        if got is None:
            links.append([]), groups.append(None), sizes.append((0, 0))
            continue
        ids_a, ends_a, ids_b, ends_b = got
        mine, j = [], 0
        for i, end in enumerate(ends_a):
            begin = ends_a[i - 1] if i else 0
            while j and ends_b[j - 1] > begin:
                j -= 1
            while ends_b[j] <= begin:
                j += 1
            while j < len(ids_b) and (ends_b[j - 1] if j else 0) < end:
                mine.append((ids_a[i], ids_b[j]))
                j += 1
            j = min(j, len(ids_b) - 1)
        cuts, p, q, names = sorted(set(ends_a) & set(ends_b)), 0, 0, []
        for cut in cuts:
            x, y = ends_a.index(cut, p) + 1, ends_b.index(cut, q) + 1
            names.append(",".join(map(str, ids_a[p:x])) + "|" + ",".join(map(str, ids_b[q:y])))
            p, q = x, y
        links.append(mine), groups.append(names), sizes.append((len(ids_a), len(ids_b)))
    counts = Counter(pair for x in links for pair in x)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    return [
        (doc_id, *size, len(names or ()), len(mine), sum(counts[x] == best[x[1]] for x in mine), sum(counts[x] for x in mine), "" if names is None else hashlib.sha256(";".join(names).encode()).hexdigest())
        for (doc_id, _), mine, names, size in zip(rows, links, groups, sizes, strict=True)
    ]


def same(df, want):
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


@pytest.fixture(scope="module")
def odd(spark, small):
    rows = list(enumerate(ODD)) + [(1000 + r.doc_id, r.text) for r in small.limit(60).collect()] + [(None, "a null id"), (3, "a repeated id")]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_against_brute_force(odd, both):
    same(alignment.aligned(odd[0]), brute(both, odd[1]))


def test_links_beyond_the_broadcast_meet_the_table(odd, both):
    same(alignment.aligned(odd[0], head=50), brute(both, odd[1]))


def test_forgetting_parts_changes_nothing(odd, both, monkeypatch):
    parts = alignment.Parts(alignment.ByteLevel(), alignment.model_of(None))
    texts = [t or "" for _, t in odd[1]]
    whole = [sum(parts.counts[p] for p in parts.of([t])[0]).tolist() for t in texts]
    monkeypatch.setattr(alignment, "MOST_PARTS", 10)
    again = [sum(parts.counts[p] for p in parts.of([t])[0]).tolist() for t in texts]
    assert whole == again and len(parts.known) < 500


def test_tricky_tables(tricky, no_documents, both):
    same(alignment.aligned(tricky), brute(both, [(r.doc_id, r.text) for r in tricky.collect()]))
    assert alignment.aligned(no_documents).isEmpty() and alignment.token_groups(no_documents).isEmpty()


def test_groups_as_rows(spark):
    rows = alignment.token_groups(spark.createDataFrame([(1, "naïve tokenizers"), (2, None)], "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows} == {1}
    assert [r.begin for r in rows][1:] == [r.end for r in rows][:-1] and rows[-1].end == len(" naïve tokenizers".encode())


def test_both_files_of_the_vocabulary_give_the_same_ids(small):
    tokenizer = alignment.ByteLevel()
    texts = [" " + (r.text or "") for r in small.collect()]
    assert [x.ids for x in tokenizer.slow.encode_batch(texts, add_special_tokens=False)] == [tokenizer.fast.encode_ordinary(t) for t in texts]
