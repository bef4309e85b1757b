"""Encoding with spans against the library's own normaliser, ids and offsets."""

import hashlib
import random

import numpy as np
import pytest

from volspark.llm import pieces

spm = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")

PARTS = [" ", "  ", "▁", "▁▁", "a", "the", "é", "é", "\n", "\t", "\x00", "ﬁ", "你好", "\U0001f600", "‍", "xxxxx", "Ünï", "<s>", "</s>", "<unk>", "<0x0A>", "<|im_end|>"]
MAPPED = [*PARTS, "Ａ", "ｶﾞ", "①", "　", " ", "​", "ﷺ", "가", "각", "가", "ﬃ", "é̂", "Å", "\U0001d400"]


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(public.path("piece_bpe_32k.model"))


def texts(parts, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(n)]


@pytest.mark.parametrize("part", [4, 1 << 14])
def test_ids_and_spans_are_the_librarys(model, monkeypatch, part):
    monkeypatch.setattr(pieces, "PART", part)
    ours, library = pieces.load(model), spm.SentencePieceProcessor(model_proto=model)
    for text in texts(PARTS, 3000, 1):
        ids, starts, ends = ours.encode(text)
        assert ids.tolist() == library.encode(text, add_eos=True)
        proto = library.encode(text, return_type="proto")
        assert list(zip(starts.tolist(), ends.tolist(), strict=True))[:-1] == [(p.begin, p.end) for p in proto.pieces]
        assert (starts[-1], ends[-1]) == (len(text.encode()),) * 2
        assert ours.decode(ids) == library.decode(ids.tolist())


def test_compiled_map_of_a_large_normaliser():
    """Longest keys, deletions, collapsed space and their offsets, with the map that the library ships for compatibility forms."""
    library = spm.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = next(dict(pieces.message_fields(v)) for k, v in pieces.message_fields(library.serialized_model_proto()) if k == pieces.NORMALIZER)
    rules = pieces.map_rules(spec[pieces.CHARSMAP])
    ours = pieces.Normaliser(rules, (), *[bool(spec.get(k, 1)) for k in (pieces.DUMMY, pieces.EXTRA, pieces.ESCAPE)])
    for text in texts(MAPPED, 3000, 2):
        got, edits = ours(text)
        want, offsets = library.normalize(text, with_offsets=True)
        assert got == want
        if got:
            at = np.concatenate(([0], np.cumsum([len(c.encode()) for c in got])))
            for e in edits:
                at = e.source(at)
            assert at.tolist() == [len(text[:o].encode()) for o in offsets]


def test_symbols_of_the_model_go_before_the_map():
    ours = pieces.Normaliser({"<": "(", "<a>": "tag", "b": ""}, ["<b>"], True, False, True)
    assert ours("<b><a><b b")[0] == "▁<b>tag(▁"


def test_documents(spark, model):
    rows = [(i, t) for i, t in enumerate(texts(PARTS, 50, 3))] + [(60, None), (61, ""), (None, "no id"), (None, "no id"), (62, "word " * 60_000), (63, "x" * 30_000)]
    docs = spark.createDataFrame([(i, t, "ids", 3) for i, t in rows], "doc_id long, text string, ids string, n_tokens long")
    library = spm.SentencePieceProcessor(model_proto=model)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encode(docs, model, ("n_tokens", "ids_sha256", "decoded_sha256")).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    full = pieces.encode(docs.filter("doc_id < 60"), model).cache()
    by_id = dict(rows)
    for r in full.collect():
        raw = by_id[r.doc_id].encode()
        assert b"".join(raw[a:b] for a, b in zip(r.starts, r.ends, strict=True)) == raw
    assert {r.doc_id: r.decoded for r in pieces.decode(full, model).collect()} == {r.doc_id: library.decode(list(r.ids)) for r in full.collect()}
    assert pieces.encode(docs.limit(0), model).count() == 0


def test_query(spark):
    from volspark.llm import registry

    sf = "/root/testdata/sf0.001"
    library = spm.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in registry.op13_sentencepiece(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_eos=True)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
