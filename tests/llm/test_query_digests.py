"""The registered queries themselves on the smallest tables: the digest columns against plain Python."""

import collections
import hashlib
import re

import pytest
import xxhash

from millrun.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def test_warc_query(spark, sf_dir):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    newest = {}
    for i, payload in pages.items():
        if len(payload) >= 1000:
            newest[payload] = max(i, newest.get(payload, i))
    got = {r.page_id: r for r in queries.op3_warc_segments(spark, sf_dir).collect()}
    assert got.keys() == pages.keys()
    for i, payload in pages.items():
        first = newest.get(payload, i)
        want = (len(payload), hashlib.sha1(payload).hexdigest(), "response" if first == i else "revisit", None if first == i else first)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want


def test_simhash_query(spark, sf_dir, texts):
    prints = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(prints)
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in prints}


def test_suffix_dedup_query(spark, sf_dir, texts):
    data = {i: t.encode() for i, t in texts.items()}
    seen = collections.Counter(hash(b[k : k + 200]) for b in data.values() for k in range(len(b) - 199))
    got = {r.doc_id: r for r in queries.op9_suffix_array_dedup(spark, sf_dir).collect()}
    assert got.keys() == data.keys()
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[hash(b[k : k + 200])] > 1:
                gone[k : k + 200] = b"\x01" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), sum(gone), runs)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_packing_query(spark, sf_dir, texts):
    rows = queries.op1_sum_of_squares_packing(spark, sf_dir).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for parts in (*pieces.values(), *sequences.values()):
        at = 0
        for p in sorted(parts):
            assert p[0] == at and p[1] > 0
            at += p[1]
        assert at == parts[0][2] if len(parts[0]) == 3 else at <= 1024


def test_fingerprint_query_edits(spark, sf_dir, texts):
    order = sorted(texts)
    got = {r.doc_id: r for r in queries.op2_imatch_fingerprints(spark, sf_dir).collect()}
    by_text = collections.defaultdict(set)
    for n, i in enumerate(order):
        t, following = texts[i], texts[order[(n + 1) % len(order)]]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text[t].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
