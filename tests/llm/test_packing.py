import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from panelforge.llm import cutting_stock, packing
from tests.llm import edge

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, length):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for doc, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want[doc].append(np.array(ids, dtype="<u4"))
    total = sum(len(a) for v in want.values() for a in v)
    assert sum(r.length for r in rows) == total
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        arrays = [a for a in want[r.doc_id] if len(a) == r.doc_tokens]
        assert any(
            zlib.crc32(a[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for a in arrays
        )
    for doc, arrays in want.items():
        assert sum(r.length for r in by_doc[doc]) == sum(map(len, arrays))
        if len(arrays) == 1:
            at = 0
            for r in sorted(by_doc[doc], key=lambda r: r.start):
                assert r.start == at
                at += r.length
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length and (at == length or at & (at - 1) == 0)


def test_documents_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    check(packing.pack(docs, PATH).collect(), pairs, 4096)
    check(packing.pack(docs, PATH, length=256, unit=4).collect(), pairs, 256)


def test_edge_cases(spark):
    docs = edge.clash(edge.docs(spark), "start", "length")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    check(packing.pack(docs, PATH).collect(), pairs, 4096)
    one = packing.pack(edge.docs(spark, [(1, None, None, None)]), PATH).collect()
    assert [(r.start, r.length, r.doc_tokens, r.offset) for r in one] == [(0, 1, 1, 0)]
    assert packing.pack(edge.docs(spark, []), PATH).count() == 0


def test_words_give_the_ids_of_the_whole_text():
    encoder = packing.Encoder(PATH)
    whole = packing.Encoder(PATH, by_word=False)
    texts = (edge.ENGLISH, edge.GERMAN, " a\u00a0b\u2003c\td\x1ce ", "don't <|endoftext|>x", "é e\u0301")
    rng = random.Random(3)
    letters = "aB1é'.,;_-#\n\t  ¦§'<|>sdmtİΣßﬁ½²\u0301eİ中x~" + " " * 6
    texts = [*texts, *("".join(rng.choices(letters, k=40)) for _ in range(3000))]
    assert encoder.encode(texts) == whole.encode(texts)


def test_patterns_are_near_the_bound():
    rng = random.Random(5)
    demand = {w: rng.randrange(1, 400) for w in range(1, 65)}
    found = cutting_stock.patterns(demand, 64)
    used = defaultdict(int)
    for p in found:
        assert sum(w * n for w, n in p.counts.items()) <= 64
        for w, n in p.counts.items():
            used[w] += n * p.times
    assert all(used[w] <= demand[w] for w in used)
    placed = sum(w * n for w, n in used.items())
    assert placed >= 0.99 * 64 * sum(p.times for p in found)
    assert placed >= 0.95 * sum(w * n for w, n in demand.items())
    assert cutting_stock.patterns({}, 64) == []
