import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scriptorium.llm import packing


def round_trip(pieces, rows, capacity=2048):
    """Each id of each row lies in one piece, each sequence is filled without gaps."""
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(((-1 if i is None else i), tuple([*bpe.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    fill = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.length > 0 and p.offset == fill.get(p.sequence_id, 0)
        fill[p.sequence_id] = p.offset + p.length
    assert not fill or max(fill.values()) <= capacity
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(-1 if p.doc_id is None else p.doc_id, []).append(p)
    for doc_id in {w[0] for w in want}:
        texts = [w[1] for w in want if w[0] == doc_id]
        got = by_doc.pop(doc_id)
        cuts = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in got)
        assert sum(p.length for p in got) == sum(map(len, texts))
        if len(texts) == 1:
            at, ids = 0, np.array(texts[0], "<u4")
            for start, length, crc, total in cuts:
                assert (start, total) == (at, len(ids)) and crc == zlib.crc32(ids[start : start + length].tobytes())
                at += length
            assert at == len(ids)
    assert not by_doc


def test_round_trip_on_documents(small):
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    out = packing.pack(small)
    round_trip(out.collect(), rows)
    assert packing.padding(out.repartition(1)).first().padding < 0.02


def test_tricky_rows(tricky, no_documents):
    out = packing.pack(tricky)
    round_trip(out.collect(), [tuple(r) for r in tricky.select("doc_id", "text").collect()])
    assert packing.pack(no_documents).count() == 0
    assert packing.padding(packing.pack(no_documents)).first().n_sequences == 0


def test_ids_come_with_pieces(tricky):
    some = packing.pack(tricky.filter("doc_id = 18"), with_ids=True).collect()
    assert sorted(len(p.ids) for p in some) == sorted(p.length for p in some)


@pytest.mark.parametrize("text", ["<|endoftext|> a<|endoftext|>b", "\x00 ﻿  \t\n\n x", "it's IT'S 12345 \U0001f469‍\U0001f680 é", " " * 5000 + "x", "名前は何ですか", "ⅷ²½ ٣"])
def test_ids_are_those_of_the_tokenizers_file(text):
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.Encoder()(text).tolist() == [*bpe.encode(text, add_special_tokens=False).ids, 1]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.Encoder()(text).tolist() == [*bpe.encode(text, add_special_tokens=False).ids, 1]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 2048), min_size=1, max_size=60))
def test_windows_hold_at_most_the_capacity(sizes):
    at = packing.windows_of(np.array(sizes), 2048)
    assert np.bincount(at, sizes).max() <= 2048


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(1).integers(1, 500, 400)
    load = np.bincount(packing.difference(sizes, 20), sizes, 20)
    assert load.sum() == sizes.sum() and load.max() - load.min() <= 5


def test_full_blocks_need_one_more_window():
    # three pieces of two thirds do not fit into two windows
    assert np.bincount(packing.windows_of(np.array([1365, 1365, 1366]), 2048), [1365, 1365, 1366]).tolist() == [0, 0, 0] or len(set(packing.windows_of(np.array([1365, 1365, 1366]), 2048).tolist())) == 3
