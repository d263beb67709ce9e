import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reconcile.llm import packing, token_ids
from reconcile.llm.queries import TOKENIZER, op7_packing, op10_token_ids
from reconcile.session import scratch_path
from tests.llm.cases import ROWS, SF_DIR, as_dicts, awkward, documents, nothing

LIBRARY = Tokenizer.from_file(TOKENIZER)


def _ids(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()


@pytest.mark.parametrize(
    "values",
    [[], [0], [2**64 - 1], [1] * 1000, [2**60 - 1, 2**60, 0], list(range(10_000)), [3, 2**63, 5] * 3000, [49_407] * 4097],
)
def test_round_trip(values):
    data = token_ids.encode(np.array(values, np.uint64))
    assert token_ids.decode(data).tolist() == values
    middle = token_ids.decode(data, 1, 2).tolist()
    assert middle == values[token_ids.BLOCK : 2 * token_ids.BLOCK]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50_000) | st.integers(0, 3), max_size=300), st.integers(1, 70))
def test_round_trip_of_any(values, block):
    assert token_ids.decode(token_ids.encode(np.array(values, np.uint64), block)).tolist() == values


def test_ids_are_below_five_bytes_each():
    ids = np.random.default_rng(1).integers(0, 49_408, 100_000)
    assert len(token_ids.encode(ids)) < 3 * len(ids)


@pytest.mark.parametrize("text", ["a b", "a\x1cb", "It's 12!?x  <|endoftext|> <|startoftext|>b", "İX Σας ΣΑΣ é ́x",
                                  "x" * 5000, " \x0b\x0c\r\n", "a b　c", "日本語 テキスト", "\x00 \x85y"])
def test_words_together_are_the_text(text):
    assert token_ids.WordIds(TOKENIZER).of([text, None]) == [_ids(text), _ids("")]


@pytest.mark.parametrize("text", ["É. çà!ß, ×. ÷- a×b é'S ü'll Ã…", "ÿ#é\u0301.é́! ð<|endoftext|>ð.", "\xaa. \xb5! µ×- é≠ Ǆ. ſ, K."])
def test_words_cut_behind_other_letters_are_the_text(text):
    ids = token_ids.WordIds(TOKENIZER)
    assert ids.of([text, "", text.upper()]) == [_ids(text), _ids(""), _ids(text.upper())]
    assert ids.of([]) == [] and ids.of([""]) == [_ids("")]


class _Counted:
    """A tokenizer that counts how often it is called."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, 0

    def encode_batch_fast(self, *args, **more):
        self.calls += 1
        return self.tokenizer.encode_batch_fast(*args, **more)


def test_unknown_words_are_coded_many_at_a_time():
    ids = token_ids.WordIds(TOKENIZER)
    ids.tokenizer = counted = _Counted(ids.tokenizer)
    text = " ".join(f"{a}{i}{b}" for i in range(1000) for a, b in (("w", ""), ("", "é."), ("", "ß")))
    assert ids.of([text]) == [_ids(text)]
    assert counted.calls <= 10


def test_words_cut_alike_are_looked_up_once():
    text = "déjà déjà. déjà, DÉJÀ"
    _, words, _ = token_ids._words([text.encode()])
    assert sorted(w.decode() for w in words) == sorted(["déjà", ".", ",", "dÉjÀ"])


def test_words_beyond_the_memory(monkeypatch):
    monkeypatch.setattr(token_ids, "_KNOWN_WORDS", 3)
    ids = token_ids.WordIds(TOKENIZER)
    texts = ["one two three four", "four five one", "six one two", ""]
    assert [ids.of([t])[0] for t in texts] == [_ids(t) for t in texts]


def _expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for doc_id, text in order:
        ids = _ids(text)
        out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def _tuples(df, *names):
    return sorted((tuple(r[n] for n in names) for r in as_dicts(df)), key=str)


def test_files_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(token_ids, "ROW_IDS", 50)
    for frame in (awkward(spark), nothing(spark)):
        path = scratch_path(spark, "ids")
        token_ids.write_ids(frame, path, TOKENIZER)
        got = sorted(as_dicts(token_ids.read_ids(spark, path)), key=lambda r: r["start"])
        rows = [(r["doc_id"], r["text"]) for r in as_dicts(frame)]
        assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(d), _ids(t)) for d, t in rows)
        assert [r["doc_id"] for r in got] == [r[0] for r in _expected(rows)]
        assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()


def test_query_against_the_library(spark):
    expected = _expected([(d["doc_id"], d["text"]) for d in documents()])
    got = _tuples(op10_token_ids(spark, SF_DIR), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == sorted(expected, key=str)


def _check_packing(pieces, rows):
    """Each id in one piece; sequences gapless and not too long. Returns ids and sequence lengths."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    texts = defaultdict(list)
    for doc_id, text in rows:
        texts[doc_id].append(_ids(text))
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        assert sum(p["length"] for p in own) == sum(len(i) // 4 for i in texts[doc_id])
        if len(texts[doc_id]) == 1:
            (ids,), at = texts[doc_id], 0
            for p in sorted(own, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids) // 4
                assert p["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + p["length"])])
                at += p["length"]
    lengths = []
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert 0 < at <= packing.LENGTH
        lengths.append(at)
    return lengths


def test_packing_of_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in ROWS]
    pieces = as_dicts(packing.pack(awkward(spark), TOKENIZER, keep_ids=True))
    _check_packing(pieces, rows)
    assert all(zlib.crc32(p["ids"]) == p["ids_crc32"] for p in pieces)
    assert packing.pack(nothing(spark), TOKENIZER).count() == 0


def test_packing_leaves_little_padding(spark):
    rows = [(d["doc_id"], d["text"]) for d in documents()]
    lengths = _check_packing(as_dicts(op7_packing(spark, SF_DIR)), rows)
    assert sum(lengths) >= 0.98 * packing.LENGTH * (len(lengths) - 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60), st.integers(1, 5))
def test_packer_holds_few_windows(sizes, windows):
    packer = packing.Packer(100, windows)
    for i, n in enumerate(sizes):
        packer.add(packing.Piece(i, 0, n, memoryview(bytes(4 * n))))
        assert len(packer.open) <= windows
    packer.merge()
    assert sum(p.length for s in packer.closed for p in s) == sum(sizes)
    held = [sum(p.length for p in s) for s in packer.closed]
    assert all(0 < h <= 100 for h in held)
    assert sum(h < 100 - packing.LEAST_CUT for h in held) <= 1
