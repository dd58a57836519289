import zlib
from collections import defaultdict

import numpy as np
import pytest

from geotrends.llm.packing import Packer, pack
from geotrends.llm.q_packing import tokenizer_path

ODD = [None, "", " ", "  a", "a  b", "a   b \n c", "\n\n x", "x \n", " a b ", "a\x1c b", "don't 'll <|endoftext|> x", "日本 語　 x", "a\u200b b\u0085 d", "Ab" * 9000]


@pytest.mark.parametrize("window,merge_parts", [(1024, 64), (64, 2)])
def test_packing(make_docs, prose, window, merge_parts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    texts = prose + ODD
    rows = pack(make_docs(texts), tokenizer_path(), window=window, max_open=4, merge_parts=merge_parts).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(docs) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(docs[i], key=lambda r: r["start"])
        assert [r["start"] for r in pieces] == list(np.cumsum([0, *(r["length"] for r in pieces)])[:-1])
        assert b"".join(bytes(r["ids"]) for r in pieces) == np.array(ids, "<u4").tobytes()
        assert {r["doc_tokens"] for r in pieces} == {len(ids)}
    used = []
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == list(np.cumsum([0, *(r["length"] for r in pieces)])[:-1])
        used.append(sum(r["length"] for r in pieces))
    assert max(used) <= window
    padding = sum(window - u for u in used if u & (u - 1))
    assert padding <= 0.02 * sum(used) + 2 * window


def test_packing_of_nothing(make_docs):
    assert pack(make_docs([]), tokenizer_path()).count() == 0
    rows = pack(make_docs([None, None], [3, 3]), tokenizer_path()).collect()
    assert [(r["doc_id"], r["length"], bytes(r["ids"]), zlib.crc32(bytes(r["ids"]))) for r in rows] == [(3, 1, b"\0" * 4, 0x2144DF1C)] * 2


def test_packer_takes_the_best_fit_and_emits_the_fullest():
    p = Packer(10, 2, 3, 0)
    assert p.place(4) == [(0, 4, 0, 0)] and p.place(7) == [(0, 7, 1, 0)]
    assert p.place(3) == [(0, 3, 1, 7)]  # best fit fills window 1
    assert p.place(8) == [(0, 8, 2, 0)]
    assert p.place(7) == [(0, 7, 3, 0)] and 2 not in p.open  # the gap of 2 is not worth a cut
    assert p.place(8) == [(0, 3, 3, 7), (3, 5, 0, 4)]  # a gap of 3 is: the rest then fits into window 0
    assert p.place(25) == [(0, 10, 4, 0), (10, 10, 5, 0), (20, 5, 6, 0)]
