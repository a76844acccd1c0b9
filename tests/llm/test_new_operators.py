"""Merkle manifest, chunk encoder and periodic runs against brute force."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from skyledger.llm import merkle, sentencepiece_chunks
from skyledger.llm.periodic_runs import collapse, densest, periodic_runs, runs
from skyledger.llm.queries import PIECES
from skyledger.llm.sentencepiece_chunks import chunks, decode, encode, processor, segment

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 Merkle


def climb(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def row_hash(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def by_hand(rows):
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of rows ``doc_id, text, lang, source, n_chars``."""
    trees = {}
    for doc_id, text, lang, source, n in rows:
        leaf = row_hash(doc_id, source, lang, n, text)
        bad = doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        trees.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, row_hash(doc_id, source, lang, n, text.replace("\n", "")) if bad else leaf))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: climb([leaf for *_, leaf, _ in sorted(trees[s])]) for s in names}
    over = climb([own[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (has_id, doc_id, leaf, node) in enumerate(sorted(trees[s])):
            proof = ""
            for tree, at in ((own[s], i), (over, k)):
                for level in tree[:-1]:
                    run = level[at - at % 3 : at - at % 3 + 3]
                    left, right = "".join(run[: at % 3]), "".join(run[at % 3 + 1 :])
                    proof, node, at = proof + left + right, sha(left + node + right), at // 3
            out.append((doc_id if has_id else None, leaf, own[s][-1][0], over[-1][0], sha(proof), node, node == over[-1][0]))
    return out


@pytest.mark.parametrize(("sizes", "depth"), [([1], 1), ([2, 1], 2), ([0], 2), ([100, 3, 1, 28, 9], 1), ([100, 3, 1, 28], 2), ([1] * 40, 1), ([82, 27], 3)])
def test_merkle_by_hand(spark, sizes, depth):
    r = random.Random(len(sizes))
    rows = [(r.randrange(300) if r.random() < 0.95 else None, r.choice(["a\nb", "", None, "no line feed", "ü\n" * 3]), r.choice(["en", None]), None if k == 2 else "" if k == 1 else f"s{k}é", r.choice([1, None])) for k, n in enumerate(sizes) for _ in range(n)]
    docs = spark.createDataFrame(rows, DOCS)
    found = [tuple(x) for x in merkle.manifest(docs, tampered=merkle.without_line_feeds(), depth=depth).collect()]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(found, key=key) == sorted(by_hand(rows), key=key)


def test_merkle_proofs_fold(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % 3}", None) for i in range(50)], DOCS)
    rows = merkle.manifest(docs, depth=2, with_proof=True).collect()
    assert len({r.root for r in rows}) == 1
    for r in rows:
        assert r.verified and merkle.fold(r.leaf, r.proof) == r.root
        assert r.proof_sha256 == sha("".join(s[1:] for s in r.proof))
        assert merkle.fold(sha("another"), r.proof) != r.root


def test_merkle_edges(odd, empty):
    rows = merkle.manifest(odd, tampered=merkle.without_line_feeds()).collect()
    assert len(rows) == odd.count() and len({r.root for r in rows}) == 1
    assert len([r for r in rows if r.doc_id == 8]) == 2 == len({r.proof_sha256 for r in rows if r.doc_id == 8})
    assert merkle.manifest(empty).count() == 0


# 12 SentencePiece


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab é1 ▁\n\t①ﬁ　\x00中😀<s>/"), max_size=40) | st.text(st.characters(exclude_categories=["Cs"]), max_size=30))
def test_chunks_are_independent(text):
    sp = processor(PIECES)
    assert [i for ids in segment(sp, chunks(text)) for i in ids] == sp.encode(text)


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 20_000, "part_bytes": 100_000}, {"block_bytes": 1, "part_bytes": 1 << 30, "held": 500}])
def test_encode_by_the_library(spark, sizes):
    """Whole ids, for one block a file, many blocks and parts, and a block a document."""
    sp = processor(PIECES)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in encode(docs, model=PIECES, **sizes).collect()}
    assert len(rows) == docs.count()
    for d in docs.collect():
        ids, r = sp.encode(d.text or ""), rows[d.doc_id]
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == sha(",".join(map(str, ids))) and r.decoded_sha256 == sha(sp.decode(ids))


def test_encode_edges(spark, odd, empty):
    sp = processor(PIECES)
    for size in (1, 1 << 20):
        rows = encode(odd, model=PIECES, block_bytes=size, part_bytes=size)
        assert sorted((r.doc_id, r.ids) for r in rows.collect()) == sorted((d.doc_id, sp.encode(d.text or "")) for d in odd.collect())
    assert sorted((r.doc_id, r.text) for r in decode(rows, model=PIECES).collect()) == sorted((d.doc_id, d.text or "") for d in odd.collect())
    assert encode(empty, model=PIECES).count() == 0
    long = spark.createDataFrame([(None, "x" * 5000), (None, "x" * 5000), (1, "a" * 5000 + " b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in encode(long, model=PIECES).collect()) == sorted((d.doc_id or 0, len(sp.encode(d.text))) for d in long.collect())


def test_other_blocks_are_an_error(spark):
    """Rows that come in another order when read again."""
    docs = spark.createDataFrame([(i, f"word{i} word{i * i}") for i in range(400)], "doc_id long, text string").repartition(2).withColumn("r", F.rand()).sortWithinPartitions("r")
    shaken = docs.mapInArrow(lambda batches: (b.take(random.sample(range(b.num_rows), b.num_rows)) for b in batches), docs.schema)
    with pytest.raises(Exception, match="write the documents first"):
        encode(shaken, model=PIECES, block_bytes=3000).collect()


def test_only_independent_chunks(monkeypatch):
    import sentencepiece

    class Crossing(sentencepiece.SentencePieceProcessor):
        def id_to_piece(self, i):
            return "a▁b"

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Crossing)
    sentencepiece_chunks.processor.cache_clear()
    with pytest.raises(ValueError, match="not independent"):
        processor(PIECES)
    sentencepiece_chunks.processor.cache_clear()


# 13 periodic runs


def runs_by_hand(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - start >= max(24, 3 * q) and not any(all(words[x] == words[x - p] for x in range(start + p, i)) for p in range(1, q)):
                out.append((start, i - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def with_runs(r):
    k = r.choice([1, 2, 3, 5])
    words = [b"%d" % r.randrange(k) for _ in range(r.randint(0, 120))]
    for _ in range(r.randint(0, 4)):
        q = r.randint(1, 45)
        base, at = [b"%d" % r.randrange(k) for _ in range(q)], r.randint(0, len(words))
        words[at:at] = (base * 8)[: r.randint(q, 5 * q + 20)]
    return words


def test_runs_by_hand():
    r = random.Random(9)
    met = 0
    for _ in range(1500):
        words = with_runs(r)
        found = runs(words)
        assert found == runs_by_hand(words)
        met += len(found)
    assert met > 500
    for n in range(20, 80):  # short texts, where a run just fits
        for q in (1, 7, 8, 9, 16, 17, 18, 25):
            words = [b"%d" % (i % q) for i in range(n)]
            assert runs(words) == runs_by_hand(words) == runs([b"x", *words])[:0] + ([(0, n, q)] if n >= max(24, 3 * q) else [])
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 400:
        a, b = b, b + a
    assert runs(b) == runs_by_hand(b)


def test_runs_of_long_texts():
    r = random.Random(3)
    assert runs([b"a"] * 300_000) == [(0, 300_000, 1)]
    period = [b"%d" % r.randrange(50) for _ in range(40_000)]
    assert runs([b"x", *(period * 4)[:130_000], b"y"]) == [(1, 130_000, 40_000)]


def test_periodic_rows(spark, odd, empty):
    r = random.Random(4)
    texts = {i: b" \n".join(with_runs(r)).decode() for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for row in periodic_runs(docs, plant=True).collect():
        words = texts[row.doc_id].encode().split()
        h, n = zlib.crc32(str(row.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = runs_by_hand(words)
        assert row.n_runs == len(found) and row.runs_sha256 == sha("".join("%d,%d,%d\n" % x for x in found))
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in found)]
        assert row.collapsed == b" ".join(kept).decode() and row.collapsed_sha256 == sha(row.collapsed) and kept == collapse(words, found)
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        assert (row.start, row.length, row.period) == best and row.exponent_milli == (1000 * best[1] // best[2] if found else None)
    rows = {x.doc_id: x for x in periodic_runs(odd).collect()}
    assert rows[6].start == 0 and rows[6].length == 3000 and rows[6].period == 1 and rows[6].collapsed == "a"
    assert rows[0].n_runs == 0 and rows[0].collapsed == "" and rows[0].start is None
    assert periodic_runs(odd).count() == odd.count() and periodic_runs(empty).count() == 0
    assert periodic_runs(spark.createDataFrame([(None, "a " * 30)], "doc_id long, text string"), plant=True).first().length == 30


def test_densest_compares_exactly():
    big = 10**15
    assert densest([(0, 3 * big, big), (5, 3 * big + 1, big), (9, 3 * big + 1, big)]) == (5, 3 * big + 1, big)
