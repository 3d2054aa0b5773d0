"""Pieces and their spans, against the library on whole texts, and its compiled maps against its own normaliser."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from scriptorium.llm import pieces

ODD = ["", " ", "  a", "a ", " ▁ x", "é ü", "\U0001f600 hi", "a\n b", "<s> </s> hello  world", "ﬁ ㌔", "\x00 a", "<0x41>", "\r\n\t", "xyz" * 4000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def offsets(texts):
    raw = [t.encode() for t in texts]
    return b"".join(raw), pieces.starts_of(np.array([len(r) for r in raw]))


def test_pieces_and_spans_are_the_librarys(small, library):
    texts = ODD + [r.text or "" for r in small.select("text").limit(150).collect()]
    got = pieces.Model().encode(*offsets(texts))
    for k, text in enumerate(texts):
        a, b = got.first[k], got.first[k + 1]
        want = [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(got.ids[a:b].tolist(), got.begins[a:b].tolist(), got.ends[a:b].tolist(), strict=True)) == want


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
def test_compiled_maps(rule):
    proto = sentencepiece_model_pb2.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    rng = random.Random(rule)
    units = ["a", " ", "  ", "ﬁ", "㌔", "é", "é", "　", "Å", "ｶﾞ", "¨", "ﷺ", "▁", "\t", "Ｑ", "ß", "İ", "​"]
    texts = ODD[:-1] + ["".join(rng.choice(units) for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    raw, offs = offsets(texts)
    for flags in range(8):
        spec = proto.normalizer_spec
        spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = bool(flags & 1), bool(flags & 2), bool(flags & 4)
        library = sentencepiece.SentencePieceNormalizer(model_proto=proto.SerializeToString())
        joined, first, place = pieces.Normaliser(spec)(np.frombuffer(raw, np.uint8), offs)
        for k, text in enumerate(texts):
            want, characters = library.normalize(text, with_offsets=True)
            at = np.cumsum([0, *(len(c.encode()) for c in text)])
            ends = np.cumsum([0, *(len(c.encode()) for c in want)])
            assert joined[first[k] : first[k + 1]].tobytes().decode() == want
            assert (place[first[k] + k + ends] - offs[k]).tolist() == at[characters].tolist()


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_digests_of_tricky_texts(tricky, library):
    want = []
    for doc_id, text in tricky.select("doc_id", "text").collect():
        ids = [*library.encode(text or ""), library.eos_id()]
        spans = np.array([(p.begin, p.end) for p in library.encode(text or "", return_type="proto").pieces], "<u4")
        want.append((doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)), zlib.crc32(spans.tobytes())))
    got = pieces.digests(tricky)
    assert got.columns == pieces.DIGESTS.names
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_encoded_texts_come_back(tricky, no_documents):
    rows = pieces.encoded(tricky).collect()
    texts = {(r.doc_id, r.text or "") for r in tricky.collect()}
    assert {(r.doc_id, r.decoded) for r in rows} == texts
    assert all(not r.ids or r.ends[-1] == len(r.decoded.encode()) for r in rows)
    assert pieces.encoded(no_documents).isEmpty() and pieces.digests(no_documents).isEmpty()


def test_models_without_byte_fallback_are_refused():
    proto = sentencepiece_model_pb2.ModelProto.FromString(open(public_tokenizers.path(pieces.MODEL), "rb").read())
    proto.trainer_spec.byte_fallback = False
    with pytest.raises(ValueError):
        pieces.Model(proto.SerializeToString())
