import hashlib
import math
from collections import Counter

import numpy as np
from conftest import SCHEMA, edge_rows, prose
from leafmill.llm import fingerprint as fp
from pyspark.sql import functions as F


def brute(rows):
    rows = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 62)), r[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, e, b = (fp.filters(x.encode()) for x in (t, edited, after))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.text_of(a), fp.text_of(e), fp.likeness(a, e), fp.likeness(a, b)))
    return out


def key(r):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)


def test_pairs_equal_brute_force(spark):
    rows = [(3 * i, prose(i, 10 + 7 * i)) for i in range(40)]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA).repartition(3)
    for size in (1 << 10, 1 << 30):
        found = [tuple(r) for r in fp.with_edited(df, bucket_bytes=size).collect()]
        assert sorted(found, key=key) == sorted(brute(rows), key=key)


def test_edge_cases(edge_docs, no_docs):
    rows = [(r[0], r[1] or "") for r in edge_rows()]
    for size in (1 << 10, 1 << 30):
        found = [tuple(r) for r in fp.with_edited(edge_docs, bucket_bytes=size).collect()]
        assert sorted(found, key=key) == sorted(brute(rows), key=key)
    assert fp.with_edited(no_docs).count() == 0


def test_ranks_are_entropies():
    raw = np.frombuffer(prose(4, 60).encode(), dtype=np.uint8)
    rank = fp.ranks(raw)
    for s in range(0, len(rank), 7):
        counts = Counter(raw[s : s + fp.WINDOW].tolist())
        entropy = -sum(c / fp.WINDOW * math.log2(c / fp.WINDOW) for c in counts.values())
        if rank[s]:
            assert abs(rank[s] / (fp._SCALE * fp.WINDOW) - entropy) < 0.05


def brute_features(data):
    """Every step spelled out, one window at a time, over the whole text."""
    w = fp.WINDOW
    data = data.ljust(w, b"\0")
    windows = [data[i : i + w] for i in range(len(data) - w + 1)]

    def rank(window):
        seen, total = Counter(), 0
        for b in window:
            seen[b] += 1
            total += fp._GAIN[seen[b]]
        left = fp._MOST - min(total, fp._MOST)
        return left if left >= int(fp._WEAK * fp._SCALE * w) else 0

    def mixed(window):
        m = int.from_bytes(window, "little") * 0xFF51AFD7ED558CCD % 2**64
        m ^= m >> 32
        m = m * 0xC4CEB9FE1A85EC53 % 2**64
        return m ^ m >> 29

    ranks, hashes = [rank(x) for x in windows], [mixed(x) for x in windows]
    points, span = Counter(), min(fp._NEIGHBOURS, len(windows))
    runs = len(windows) - span + 1
    for s in range(runs):
        best = max(range(s, s + span), key=lambda i: (ranks[i], -i))
        if ranks[best]:
            points[best] += 1
    first = {}
    for i, m in enumerate(hashes):
        first.setdefault(m, i)
    rarest = sorted(first, key=lambda m: (-ranks[first[m]], m))[: fp._LEAST]
    places = {i for i, n in points.items() if n >= min(fp._POPULAR, runs)} | {first[m] for m in rarest}
    out = []
    for i in sorted(places):
        if hashes[i] not in out:
            out.append(hashes[i])
    return out


def test_features_equal_brute_force(monkeypatch):
    texts = [prose(s, n).encode() for s, n in ((1, 1), (2, 3), (3, 9), (4, 40), (5, 130), (6, 400))]
    texts += [b"", b"a", b"aaaaaaa", b"a" * 300, b"ab" * 90, prose(7, 60).encode() * 5, "é\U0001f600".encode() * 9, bytes(range(256)) * 2]
    for block in (1 << 19, 64, 100):  # block edges must not show
        monkeypatch.setattr(fp, "_BLOCK", block)
        for t in texts:
            assert fp.features(t).tolist() == brute_features(t)


def test_two_bytes_less_stay_alike_at_every_length():
    text = prose(11, 400).encode()
    chains = {n: fp.filters(text[:n]) for n in range(98, 1001)}
    assert min(fp.likeness(chains[n], chains[n - 2]) for n in range(100, 1001)) > 0.8
    assert fp.likeness(chains[321], chains[319]) > 0.8 and fp.likeness(chains[320], chains[318]) > 0.8


def test_textual_ids_and_null_fingerprints(spark):
    rows = [(i, f"k{i:02d}" if i else None, prose(i, 30)) for i in range(9)]
    named, numbered = (spark.createDataFrame([(r[k], r[2]) for r in rows], f"doc_id {t}, text string") for k, t in ((1, "string"), (0, "long")))
    a, b = ({r.fingerprint: (r.edited_sha256, r.near_edited, r.near_next) for r in fp.with_edited(d, bucket_bytes=200).collect()} for d in (named, numbered))
    assert a == b and len(a) == 9
    df = spark.createDataFrame([(None, "0"), ("0", "0")], "a string, b string")
    assert [r[0] for r in df.select(fp.compare(df["a"], df["b"])).collect()] == [None, 1.0]
    assert spark.createDataFrame([(None,)], "t string").select(fp.fingerprint(F.col("t"))).first()[0] == fp.EMPTY


def test_likeness():
    a, b = (fp.filters(prose(s, 900).encode()) for s in (1, 2))
    half = fp.filters((prose(1, 900)[:2500] + prose(2, 900)[:2500]).encode())
    assert fp.likeness(a, a) == 1 and fp.likeness(a, b) < 0.3 < fp.likeness(a, half) < 0.95
    assert fp.likeness(a, half) == fp.likeness(half, a)
    assert (fp.chain_of(fp.text_of(a)) == a).all() and fp.text_of(fp.filters(b"")) == fp.EMPTY
    assert fp.likeness(fp.filters(b""), fp.filters(b"")) == 1 and fp.likeness(fp.filters(b""), a) == 0
