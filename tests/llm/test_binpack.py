import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from conftest import edge_rows
from leafmill.llm import binpack, packing
from leafmill.llm.common import table
from tokenizers import Tokenizer


def check(rows, pieces, seq_len):
    """Round trip with the tokenizers file, cuts, offsets; returns the number of sequences and of tokens."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = Counter((d, tuple(t.encode(x or "", add_special_tokens=False).ids + [2])) for d, x in rows)
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
        assert p.length == len(p.ids) // 4 and 0 < p.length <= seq_len
    got = Counter()
    for d, ps in docs.items():
        by_start = defaultdict(list)
        for p in ps:
            by_start[p.start].append(p)
        copies = len(by_start[0])
        if copies == 1:
            ps.sort(key=lambda p: p.start)
            assert [p.piece for p in ps] == list(range(len(ps))) and all(p.length == seq_len for p in ps[1:])
            assert [p.start for p in ps] == [0, *np.cumsum([p.length for p in ps])[:-1]]
            got[d, tuple(i for p in ps for i in np.frombuffer(p.ids, "<u4").tolist())] += 1
    repeated = {d for d, n in Counter(d for d, _ in rows).items() if n > 1}
    assert got == Counter({k: n for k, n in wanted.items() if k[0] not in repeated})
    assert sum(p.length for p in pieces) == sum(len(i) * n for (_, i), n in wanted.items())
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= seq_len
    return len(sequences), sum(p.length for p in pieces)


def test_round_trip_and_fill(spark, sf):
    docs = table(spark, sf, "documents")
    pieces = binpack.pack(docs).collect()
    sequences, tokens = check([(r.doc_id, r.text) for r in docs.collect()], pieces, 1024)
    assert sequences <= 1.02 * -(-tokens // 1024) + 1
    crc = {(r.doc_id, r.piece): r.ids_crc32 for r in binpack.digest(binpack.pack(docs)).collect()}
    assert crc == {(p.doc_id, p.piece): zlib.crc32(p.ids) for p in pieces}


def test_many_partitions_merge(spark, sf):
    """Small partitions in three levels come close to one best fit over everything."""
    docs = table(spark, sf, "documents").repartition(9)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sequences, tokens = check(rows, binpack.pack(docs, seq_len=1024, most=16).collect(), 1024)
    whole, _ = check(rows, binpack.pack(docs, seq_len=1024).collect(), 1024)
    assert whole <= sequences <= 1.1 * whole + 2


def test_edge_cases(spark, edge_docs, no_docs):
    rows = [(r[0], r[1]) for r in edge_rows()]
    for most in (1 << 15, 8):
        check(rows, binpack.pack(edge_docs, seq_len=64, most=most).collect(), 64)
    assert binpack.pack(no_docs).count() == 0
    check(rows, binpack.pack(edge_docs, seq_len=1).collect(), 1)


def plain_best_fit(sizes, room):
    bins = []
    for s in sorted(sizes, reverse=True):
        fitting = [b for b in range(len(bins)) if bins[b] + s <= room]
        if fitting:
            bins[max(fitting, key=lambda b: bins[b])] += s
        else:
            bins.append(s)
    return sorted(bins)


def test_best_fit_equals_plain_search():
    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 400):
        sizes = rng.integers(1, 101, n)
        place, fills = binpack.best_fit(sizes, 100)
        assert sorted(fills.tolist()) == plain_best_fit(sizes.tolist(), 100)
        assert np.bincount(place, weights=sizes, minlength=len(fills)).tolist() == fills.tolist()


def test_rounds_keep_every_item_once(spark):
    items = spark.range(3000).selectExpr("id AS row", "pmod(hash(id), 90) + 5 AS length")
    stored = binpack.rounds(items, 100, most=64)
    assert len(stored) >= 3
    closed = [b for k, s in enumerate(stored) for b in (s if k == len(stored) - 1 else s.where("NOT is_open")).collect()]
    assert sorted(m for b in closed for m in b.members) == list(range(3000))
    assert all(sum(b.lengths) <= 100 for b in closed)


def test_tokenising_calls_the_encoder_once_a_text(monkeypatch):
    encode, calls = packing._Tokens(packing.default_ranks()), []
    inner = encode.encoding
    encode.encoding = type("Counted", (), {"__getattr__": lambda _, name: lambda *a, **k: calls.append(name) or getattr(inner, name)(*a, **k)})()
    monkeypatch.setattr(binpack, "tokens_of", lambda path: encode)
    monkeypatch.setattr(binpack, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("Context", (), {"partitionId": lambda _: 0})())}))
    texts = [None, "", " ".join(f"w{i}q" for i in range(2000)), "a b"]
    batch = pa.record_batch([pa.array(range(4), pa.int64()), pa.array(range(4), pa.int64()), pa.array(texts)], names=["row", "doc_id", "text"])
    found = [np.frombuffer(i, "<u2").tolist() for b in binpack._tokenised([batch], "", 2, 1024) for i in b.column("ids").to_pylist()]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert found == [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]
    assert len(calls) == 2
