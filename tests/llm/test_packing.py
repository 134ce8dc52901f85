import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weekcast.llm.packing import TOKENIZER, OpenWindows, pack
from weekcast.llm.tokens import LowerWordEncoder

ODD = [None, "", " ", "It's we'll 'stop ''x 12ab3 É!?'s", "<|endoftext|> a<|startoftext|>", "Σίσυφος ΟΔΟΣ İstanbul", "é ﬁ   x\x1cy\x85z", "漢字かな 🙂👍🏽", "a\x00b", "word " * 9000, "don't DON'T ÀÉ×÷ß ŸĀ"]


def test_encoder_equals_the_library(documents):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = [t or "" for t in ODD] + [r.text for r in documents.collect()]
    encoder = LowerWordEncoder(TOKENIZER)
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check_windows(rows, window):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= window
    return len(sequences)


@pytest.mark.parametrize("group_rows", [2000, 20])
def test_pack_covers_every_id_once(docs_of, documents, group_rows):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = ODD + [r.text for r in documents.collect()]
    rows = pack(docs_of(texts).repartition(3), group_rows=group_rows).collect()
    n = check_windows(rows, 4096)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    total = 0
    for i, t in enumerate(texts):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        total += at
    if group_rows == 2000:
        assert n <= total / 4096 * 1.01 + 2


def test_null_and_repeated_ids_and_empty(docs_of):
    rows = pack(docs_of([(1, "a"), (1, "a"), (None, "b"), (None, None)])).collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in rows) == [("1", 2), ("1", 2), ("None", 1), ("None", 2)]
    check_windows(rows, 4096)
    assert pack(docs_of([])).collect() == []


@given(st.lists(st.integers(1, 37), max_size=80))
@settings(max_examples=60, deadline=None)
def test_tree_finds_the_tightest_window(lengths):
    tree, plain = OpenWindows(37), {}
    for length in sorted(lengths, reverse=True):
        fit = [c for c in plain.values() if c >= length]
        number, offset = tree.place(length)
        assert 37 - offset == (min(fit) if fit else 37)
        assert plain.get(number, 37) == 37 - offset
        plain[number] = 37 - offset - length
