"""Token counts, byte-level BPE and packing against their libraries."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from lumicurve.llm.byte_bpe import MatrixBPE, TextEncoder, bpe_round_trip
from lumicurve.llm.packing import BoundedBestFit, FileEncoder, pack_sequences
from lumicurve.llm.token_counts import PieceCounter, token_counts

from samples import ODD, noise, odd_rows

ALPHABET = "ab e\n\t's1２,.|é🎉  　\x85\x1c"
TEXTS = [t for t in ODD if t is not None] + noise(3, 1500, ALPHABET, 80)


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(tik):
    encoder = TextEncoder.of(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for text, ids in zip(TEXTS, encoder.encode(pa.array(TEXTS)), strict=True):
        assert ids.tolist() == tik.encode_ordinary(text), text[:80]
        assert encoder.bpe.decode(ids.tolist()) == text.encode()


def test_folded_rows_equal_matrices():
    bpe = MatrixBPE.from_file(P.path("byte_bpe_50k.tiktoken"))
    items = [t.encode() for t in noise(9, 300, "abcthe ing", 40) if t]
    wide = bpe.encode_many(items)
    bpe.widest = 1
    for a, b in zip(wide, bpe.encode_many(items), strict=True):
        assert a.tolist() == b.tolist()


def test_long_rows_equal_library(tik):
    bpe = MatrixBPE.from_file(P.path("byte_bpe_50k.tiktoken"))
    for text in ("x" * 9000, *(t * 120 for t in noise(10, 3, "abcdefghijklmnopqrstuvwxyz", 90) if t)):
        assert bpe.encode_many([text.encode()])[0].tolist() == tik.encode_ordinary(text)


def test_table_survives_being_emptied(tik):
    encoder = TextEncoder(MatrixBPE.from_file(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    encoder.table.most, encoder.table.block = 50, 200
    for text, ids in zip(TEXTS[-300:], encoder.encode(pa.array(TEXTS[-300:])), strict=True):
        assert ids.tolist() == tik.encode_ordinary(text)


def test_round_trip_query(odd, no_docs, tik):
    out = bpe_round_trip(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(out) == len(odd_rows())
    texts = dict(odd_rows())
    for r in out:
        text = texts[r.doc_id] or ""
        ids = tik.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe_round_trip(no_docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []


def test_piece_counts_equal_library(odd, no_docs):
    counter = PieceCounter(P.path("piece_bpe_32k.model"))
    assert counter.count(TEXTS) == [len(x) for x in counter.model.encode(TEXTS)]
    out = token_counts(odd, P.path("piece_bpe_32k.model"), 4096).collect()
    texts = dict(odd_rows())
    for r in out:
        text = texts[r.doc_id] or ""
        n = len(counter.model.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 4096)
    assert len(out) == len(odd_rows())
    assert token_counts(no_docs, P.path("piece_bpe_32k.model")).collect() == []


def test_packing(odd, no_docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = pack_sequences(odd, P.path("byte_bpe_50k.json"), with_ids=True).toPandas()
    by_sequence = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")["length"]
    assert by_sequence.sum().max() <= 2048
    assert (by_sequence.cumsum() - out.sort_values(["sequence_id", "offset"])["length"] == out.sort_values(["sequence_id", "offset"])["offset"]).all()
    texts = dict(odd_rows())
    total = 0
    for r in out.itertuples():
        text = "a row without an id" if r.doc_id != r.doc_id else texts[int(r.doc_id)] or ""
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        part = ids[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and bytes(r.ids) == part.tobytes()
        assert r.piece == 0 or r.length == 2048
        total += r.length
    assert out["sequence_id"].nunique() <= total / 2048 + 3
    online = pack_sequences(odd, P.path("byte_bpe_50k.json"), lot=1).toPandas()
    assert online.groupby("sequence_id")["length"].sum().max() <= 2048 and online["length"].sum() == total
    assert out["sequence_id"].nunique() <= online["sequence_id"].nunique() <= total / 2048 + 4
    assert pack_sequences(no_docs, P.path("byte_bpe_50k.json")).collect() == []


def test_file_encoder_cuts_special_tokens():
    encoder = FileEncoder(P.path("byte_bpe_50k.json"))
    assert [i.tolist() for i in encoder.encode(pa.array(["a<|endoftext|>b", None, "a"]))][0][1] == 50256


def test_best_fit_bounds_open_sequences():
    fit = BoundedBestFit(10, 2)
    places = [fit.put(s) for s in (6, 7, 3, 4, 8, 5, 2)]
    assert places[2] == (1, 7) and places[3] == (0, 6)
    assert fit.open <= 2
