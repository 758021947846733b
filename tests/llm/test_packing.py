import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from conftest import SCHEMA, edge_rows
from leafmill.llm import packing
from leafmill.llm.common import table
from tokenizers import Tokenizer


def ids_of(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, pieces, seq_len=2048):
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    wanted = defaultdict(list)
    for (d, _), ids in zip(rows, ids_of([t for _, t in rows]), strict=True):
        wanted[d].append(ids)
    for d, texts in wanted.items():
        got = sorted((p.start, np.frombuffer(p.ids, "<u4").tolist()) for p in by_doc[d])
        if len(texts) == 1:
            assert [i for _, part in got for i in part] == texts[0]
            assert {p.doc_tokens for p in by_doc[d]} == {len(texts[0])}
        else:
            assert sum(len(part) for _, part in got) == sum(map(len, texts))
    short = 0
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at and p.length == len(p.ids) // 4
            at += p.length
        assert at <= seq_len
        short += at < seq_len
    assert short <= 1


def test_round_trip(spark, sf):
    docs = table(spark, sf, "documents")
    check([(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs).collect())
    digest = packing.digest(packing.pack(docs.where("doc_id = 3"))).collect()
    ids = ids_of([docs.where("doc_id = 3").first().text])[0]
    assert [r.ids_crc32 for r in digest] == [zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in digest]


def test_edge_cases(spark, edge_docs, no_docs):
    check([(r[0], r[1]) for r in edge_rows()], packing.pack(edge_docs, seq_len=64).collect(), 64)
    assert packing.pack(no_docs).count() == 0
    odd = [(1, "a  b"), (2, "end "), (3, "<|endoftext|> x<|endoftext|>"), (4, " lead"), (5, "tab\t x\n y   z"), (6, "it's we'll 'S"), (7, " em　 q"), (8, "é क्ष x")]
    check(odd, packing.pack(spark.createDataFrame([(d, t, None, None, None) for d, t in odd], SCHEMA)).collect())


def test_hilbert_order_is_a_walk():
    """Cells of a grid in key order are neighbours, and keys are a bijection."""
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = packing.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(side**dims))
        walk = grid[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_a_text_is_one_call_of_the_encoder():
    """However many words it has; the ids stay those of the tokenizers file."""
    encode, calls = packing._Tokens(packing.default_ranks()), []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return lambda *a, **k: calls.append(name) or getattr(self.inner, name)(*a, **k)

    encode.encoding = Counted(encode.encoding)
    texts = [" ".join(f"w{i * 7919 % 10007}x" for i in range(3000)), "<|endoftext|> x<|endoftext|>", "a  b", "tab\t x\n y "]
    assert [np.frombuffer(encode(t), "<u2").tolist() + [1] for t in texts] == ids_of(texts)
    assert len(calls) == len(texts)
