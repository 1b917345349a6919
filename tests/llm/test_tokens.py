"""BPE, packing and token attribution against the tokenizer library and plain rules."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from candor.llm import attribution, bpe, packing

TEXTS = ["", None, "Hello world", "  two  spaces\n\n\nlines \t", "naïve Straße 日本語 😀​ x", "a" * 3000, "ab " * 500, "don't we'll 12345 !!?", "Hello world"]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = bpe.load_ranks(bpe.tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoder_equals_library(library, text):
    text = text.encode("utf-8", "ignore").decode()
    own = bpe.encoder("byte_bpe_multi_50k.tiktoken")
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abes tinghé1", min_size=1, max_size=40))
def test_pieces_equal_plain_merges(text):
    own = bpe.encoder("byte_bpe_multi_50k.tiktoken")
    piece = text.encode()
    plain = [own.ranks[piece]] if piece in own.ranks else own.merges(piece)
    assert own.encode_piece(piece) == plain


def test_compatibility_is_what_merging_says():
    own = bpe.encoder("byte_bpe_multi_50k.tiktoken")
    rng = np.random.default_rng(2)
    for a, b in rng.integers(0, 3000, (2000, 2)).tolist():
        assert own._compatible(a, b) == (own.merges(own.bytes_of[a] + own.bytes_of[b]) == [a, b])


def test_digests(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, token_ids string")
    got = {r["doc_id"]: r for r in bpe.encoding_digests(docs).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encoding_digests(docs.where("doc_id < 0")).count() == 0
    assert bpe.encode_documents(docs).columns == ["doc_id", "text", "n_tokens", "token_ids", "decoded"]


def plain_best_fit(lengths, capacity):
    rows, room = [], []
    for i, n in enumerate(lengths):
        fits = [r for r in range(len(rows)) if room[r] >= n]
        if fits:
            r = min(fits, key=lambda r: room[r])
        else:
            rows.append([])
            room.append(capacity)
            r = len(rows) - 1
        rows[r].append(i)
        room[r] -= n
    return rows, room


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_leaves_the_rooms_of_the_plain_rule(lengths):
    lengths = sorted(lengths, reverse=True)
    rows = packing.best_fit_decreasing(lengths, 20)
    plain, room = plain_best_fit(lengths, 20)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    assert sorted(20 - sum(lengths[i] for i in r) for r in rows) == sorted(room) and len(rows) == len(plain)


def test_packing_round_trip(spark, library):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    packed = packing.pack_documents(docs, length=64, shard_bytes=2000).cache()
    pieces = {}
    for r in packing.unpack(packed).collect():
        pieces.setdefault(r["doc_id"], {})[r["piece"]] = np.frombuffer(r["ids"], "<u4").tolist()
    for i, t in enumerate(TEXTS):
        whole = [x for k in sorted(pieces.get(i, {})) for x in pieces[i][k]]
        assert whole == library.encode_ordinary(t or "")
    for r in packed.collect():
        cut, positions = r["cu_seqlens"], np.frombuffer(r["position_ids"], "<u4")
        assert len(positions) == 64 == len(r["input_ids"]) // 4 and cut[-1] == r["n_tokens"] <= 64
        for a, b in zip(cut, cut[1:], strict=False):
            assert positions[a:b].tolist() == list(range(b - a))
    assert packing.pack_documents(docs.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution_against_byte_by_byte(spark, library, rule):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {}
    for r in attribution.token_counts(docs, rule).orderBy("doc_id", "section").collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(TEXTS):
        lines = (t or "").splitlines(keepends=True) if "\n" in (t or "") else [t or ""]
        assert "".join((t or "")[r["char_start"] : r["char_end"]] for r in got[i]) == (t or "")
        want, at, owner = [0.0] * len(lines), 0, [k for k, x in enumerate(lines) for _ in x.encode()]
        for token in library.encode_ordinary(t or ""):
            n = len(library.decode_single_token_bytes(token))
            over = owner[at : at + n]
            at += n
            if rule == "start":
                want[over[0]] += 1
            elif rule == "share":
                for k in over:
                    want[k] += 1 / n
            else:
                want[max(sorted(set(over)), key=over.count)] += 1
        assert [r["n_tokens"] for r in got[i]] == pytest.approx(want)


def test_packing_of_repeats_and_null_ids(spark, library):
    rows = [(None, "one two three " * 40)] * 3 + [(7, "four five " * 30)] * 2 + [(None, "six"), (7, "seven"), (8, None)]
    docs = spark.createDataFrame([(*r, "s", 1, b"x") for r in rows], "doc_id long, text string, shard string, piece int, ids binary")
    pieces = packing.unpack(packing.pack_documents(docs, length=64, shard_bytes=200)).collect()
    got = sorted((str(r["doc_id"]), r["piece"], np.frombuffer(r["ids"], "<u4").tolist()) for r in pieces)
    ids = [(i, library.encode_ordinary(t or "")) for i, t in rows]
    want = sorted((str(i), k, whole[k * 64 : k * 64 + 64]) for i, whole in ids for k in range(-(-len(whole) // 64)))
    assert got == want


def test_attribution_of_repeats_no_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b\nc", "x", 1, 2), (1, "a b\nc", "x", 1, 2), (None, "a", "x", 1, 2)], "doc_id long, text string, section string, n_tokens int, char_start int")
    got = sorted((str(r["doc_id"]), r["section"], r["n_tokens"]) for r in attribution.token_counts(docs).collect())
    assert len(got) == 5 and got[0] == got[1] and got[2] == got[3]
    assert attribution.token_counts(docs.where("doc_id < 0")).count() == 0
