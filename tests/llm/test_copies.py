"""SimHash, repeated strings, passages and vectors against brute force, and their edge cases."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from plinthwork.functions.storage import cut
from plinthwork.llm import passages, repeats, simhash, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, component_id string, body string, node string"


def frame(spark, rows):
    """Documents with further columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z", "w") for i, t in rows], DOCS)


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    cut = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(c, 42) for c in cut]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    texts = [prose(rng, n) for n in [1, 2, 3, 4, 5, 30, 90, 150, 200, 300] * 3]
    for t in texts[6:10] * 5:  # near copies
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [texts[9]] * 12 + ["", None, " \t\n", "A b C", "a B c", "Ünï Côdé ünï", "ab " * 400, "x" * 1500, texts[8] + " tail", "head " + texts[8] + " " + texts[9]]
    return [(i, t) for i, t in enumerate(texts)]


def test_covering_masks_cover_every_pair_within_the_radius():
    masks, rng = simhash.covering_masks(), random.Random(3)
    assert len(masks) == 31 and all(28 <= bin(m).count("1") <= 36 for m in masks)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(not diff & m for m in masks)


def test_simhash_components(spark, corpus):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(frame(spark, corpus)).collect()}
    fp = {i: brute_fingerprint(t) for i, t in corpus}
    want = components(fp, [(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 4])
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def test_simhash_blocks_of_a_large_bucket_lose_no_link(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = {base} | {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for _ in range(150)}
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    got = components(values, [tuple(x % (1 << 64) for x in r) for r in simhash.links(fps, block=16).collect()])
    assert got == components(values, [(a, b) for a in values for b in values if a < b and bin(a ^ b).count("1") <= 4])


def test_simhash_buckets_are_not_broadcast(spark):
    fps = cut(spark.range(1000).selectExpr("xxhash64(id) fp"), "fps")  # a small file: its size is all that Spark knows of the rows exploded from it
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_suffix_order_sorts_few_times(monkeypatch):
    rng, sorts, sort = random.Random(4), [], np.argsort
    monkeypatch.setattr(repeats.np, "argsort", lambda *a, **k: sorts.append(1) or sort(*a, **k))
    for text in (b"\0" * 40, b"a\0" * 30 + b"\0", bytes(rng.choice(b"ab\0") for _ in range(500)), bytes(rng.choice(b"abcdef") for _ in range(3000)) * 2):
        sorts.clear()
        assert repeats.suffix_order(np.frombuffer(text, np.uint8)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    assert len(sorts) <= 7  # for ties of 3,000 bytes


def test_one_document_of_each_group_stays(spark, corpus):
    rows = [*corpus, (3, corpus[3][1]), (3, corpus[3][1]), (None, corpus[9][1])]
    kept = simhash.one_of_each_group(frame(spark, rows))
    want = {r.component_id for r in simhash.simhash_components(frame(spark, corpus)).collect()}
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert simhash.simhash_components(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    assert passages.passage_components(none).count() == 0
    assert vectors.vector_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "one two three four five"), (4, "one two three four five"), (4, "one two three four five"), (None, None)]
    got = simhash.simhash_components(frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 4), (4, 4), (4, 4)]
    assert passages.passage_components(frame(spark, rows)).count() == 4
    assert repeats.remove_repeats(frame(spark, rows)).count() == 4


def test_run_index_statistics_are_the_longest_other_match():
    rng = random.Random(1)
    for _ in range(150):
        t = bytes(rng.choice([0, 1, 97, 98, 255][: rng.randint(1, 5)]) for _ in range(rng.randint(1, 50)))
        index = repeats.RunIndex(t)
        assert repeats.suffix_order(np.frombuffer(t, np.uint8)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        for i in range(len(t)):
            want = max([next((k for k in range(len(t)) if max(i, j) + k >= len(t) or t[i + k] != t[j + k]), 0) for j in range(len(t)) if j != i], default=0)
            assert index.statistics[i] == want
    assert repeats.RunIndex(b"").statistics.size == 0
    assert repeats.RunIndex(b"ab" * 500).n_runs < 10


def brute_repeats(rows, length):
    seen = defaultdict(list)
    bodies = [(t or "").encode() for _, t in rows]
    for k, b in enumerate(bodies):
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]].append((k, p))
    cover = [np.zeros(len(b) + 1, np.int8) for b in bodies]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                cover[k][p : p + length] = 1
    return sorted((i if i is not None else -1, len(b), int(c.sum()), int((np.diff(np.concatenate(([0], c))) == 1).sum()), hashlib.sha256(bytes(x for x, m in zip(b, c) if not m)).hexdigest()) for (i, _), b, c in zip(rows, bodies, cover))


@pytest.mark.parametrize("group, passage", [(1024, None), (1, None), (1024, 200), (1, 200)])
def test_removal_of_repeats(spark, corpus, group, passage):
    rng = random.Random(2)
    shared = prose(rng, 120)
    rows = [*corpus, *[(1000 + k, prose(rng, 20) + " " + shared + " " + prose(rng, 20 + k)) for k in range(6)], (1000, corpus[9][1]), (None, shared), (2000, "日本語テキスト" * 90), (2001, "é日本語テキスト" * 90)]
    rows += [(3000, "xy" * 700 + passage_of(rng, 40)), (3001, passage_of(rng, 40) + "xy" * 150), (3002, ("abc " * 30 + prose(rng, 3) + " ") * 9)]
    got = repeats.remove_repeats(frame(spark, rows), group=group, passage=passage, with_text=True).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, 400)
    left = sorted((r.doc_id if r.doc_id is not None else -1, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got if r.doc_id not in (2000, 2001))  # whose characters may be cut in two
    assert left == sorted((i, digest) for i, _, _, _, digest in brute_repeats(rows, passage or 400) if i not in (2000, 2001))


def passage_of(rng, n):
    return " " + prose(rng, n) + " "


def test_a_crowded_passage_is_judged_by_its_surroundings(spark):
    """One line in many texts with other text around it, twice with the same: anchors that no index would hold."""
    rng = random.Random(21)
    line, longer = prose(rng, 24)[:100], prose(rng, 80)[:330]
    rows = [(k, prose(rng, 60) + " " + (line if k % 2 else longer) + " " + prose(rng, 60)) for k in range(240)]
    rows += [(1000 + k, "tail " * k + rows[k][1][-480 - 3 * k :]) for k in range(12)] + [(2000, longer + longer)]
    for passage in (None, 150):
        got = repeats.remove_repeats(frame(spark, rows), passage=passage, group=20, with_text=True).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, 400)
        assert sorted((r.doc_id, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got) == [(r[0], r[4]) for r in brute_repeats(rows, passage or 400)]


def test_kept_text_is_what_is_left(spark):
    rng = random.Random(4)
    shared = prose(rng, 150)
    rows = [(1, "left " + shared + " right"), (2, shared), (3, None)]
    got = {r.doc_id: r.kept for r in repeats.remove_repeats(frame(spark, rows), keep=("lang",), with_text=True).collect()}
    assert got == {1: "left  right", 2: "", 3: ""}


def test_very_long_texts_are_cut_in_overlapping_spans():
    rng = random.Random(9)
    long = prose(rng, 60_000).encode()
    row, start, size, span, times, base, anchor, content = repeats.segments([long, b"short", long[150_000:180_000]])
    assert set(row.tolist()) == {0, 2} and max((start + span)[row == 0]) == len(long)
    inner = set(zip(anchor[row == 2].tolist(), content[row == 2].tolist()))
    assert len(inner & set(zip(anchor[row == 0].tolist(), content[row == 0].tolist()))) >= len(inner) - 4


def test_texts_at_the_span_boundary_keep_what_is_unique(spark):
    rng = random.Random(12)
    shared = prose(rng, 120)
    rows = [(k, (prose(rng, 30_000) + shared)[-n:]) for k, n in enumerate((repeats._SPAN - 1, repeats._SPAN, repeats._SPAN + 1))]
    got = repeats.remove_repeats(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, 400)


def test_compact_windows_are_the_minima_of_long_subsequences():
    rng = np.random.default_rng(0)
    for n, least in ((5, 8), (8, 8), (60, 8), (200, 16)):
        x = rng.integers(0, 40, n).astype(np.uint64)
        v = passages._mixed(x, 1) & ~passages._POS
        c, l, r = passages.compact_windows(x, 1, least)
        for a in range(n):
            for b in range(a + least - 1, n):
                low = a + int(np.argmin(v[a : b + 1]))
                assert sum((c == low) & (l <= a) & (b <= r)) == 1
        assert all(r - l + 1 >= least)


def test_passages_link_exact_and_near_copies(spark):
    rng = random.Random(11)
    shared = prose(rng, 60).split()
    near = list(shared)
    near[30] = "other"
    rows = [(k, prose(rng, 100)) for k in range(20)]
    rows += [(100 + k, prose(rng, 40) + " " + " ".join(shared) + " " + prose(rng, 50)) for k in range(5)]
    rows += [(200, prose(rng, 40) + " " + " ".join(near) + " " + prose(rng, 50)), (300, " ".join(shared[:30])), (301, None), (302, "")]
    for block in (512, 2):
        got = {r.doc_id: r.component_id for r in passages.passage_components(frame(spark, rows), block=block).collect()}
        assert got == {i: 100 if 100 <= i <= 200 else i for i, _ in rows}


@pytest.mark.parametrize("kind", ["edits", "repeats", "moves"])
def test_similar_passages_are_those_of_all_lengths_and_offsets(kind):
    rng, least, reach, found = random.Random(5), 5, passages.reach_of(5, 0.8), 0
    for _ in range(60):
        a = [rng.randint(1, 6) if kind == "repeats" else k + 100 for k in range(2 * reach + 1)]
        b = list(a)
        for _ in range(rng.randint(2, 5)):
            at, n = rng.randrange(len(b)), rng.randint(1, 3)
            b[at : at + rng.randint(0, 2)] = [rng.randint(1000, 9999) for _ in range(n)]
        if kind == "moves":
            at = rng.randrange(reach - 3, reach + 3)
            b = b[at : at + 4] + b[:at] + b[at + 4 :]
        c = a[reach]
        if c not in b:
            continue
        at = b.index(c)
        b = ([0] * reach + b + [0] * reach)[at : at + 2 * reach + 1]
        spans = [[set(x[s:e]) for s in range(reach + 1) for e in range(max(reach + 1, s + least), len(x) + 1) if 0 not in x[s:e]] for x in (a, b)]
        want = any(len(p & q) >= 0.8 * len(p | q) for p in spans[0] for q in spans[1])
        assert passages._similar(np.array(a, np.uint32), np.array(b, np.uint32), least, 0.8) == want
        found += want
    assert 0 < found


def test_passages_with_words_put_in_or_taken_out_are_linked(spark):
    rng = random.Random(13)
    rows, want = [], {}
    for k in range(2, 11):
        shared = prose(rng, 80).split()
        for i, words in ((100 * k, shared), (100 * k + 1, shared[:40] + prose(rng, k).split() + shared[40:])):
            rows.append((i, prose(rng, 70) + " " + " ".join(words) + " " + prose(rng, 60 + k)))
            want[i] = 100 * k
    for k in range(2, 7):
        shared = prose(rng, 120).split()
        for i, words in ((5000 + 10 * k, shared), (5001 + 10 * k, shared[:60] + shared[60 + k :])):
            rows.append((i, prose(rng, 70) + " " + " ".join(words) + " " + prose(rng, 60)))
            want[i] = 5000 + 10 * k
    assert {r.doc_id: r.component_id for r in passages.passage_components(frame(spark, rows)).collect()} == want


def test_a_line_repeated_within_one_document_is_not_shared(spark):
    rng = random.Random(14)
    line, other = prose(rng, 30), prose(rng, 60)
    rows = [(1, " ".join(prose(rng, 40) + " " + line for _ in range(6))), (2, other + " " + prose(rng, 50)), (3, prose(rng, 50) + " " + other)]
    got = {r.doc_id: r.n_shared for r in passages.passage_components(frame(spark, rows)).collect()}
    assert got[1] == 0 < min(got[2], got[3])


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16))
    x[100:200] = x[:100] + 0.12 * rng.standard_normal((100, 16))
    x[200:240] = x[5] + 0.01 * rng.standard_normal((40, 16))
    x[240] = x[241] = x[3]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] * 16), (404, []), (405, [1.0] * 4), (406, [2.0] * 4), (None, rows[3][1]), (7, rows[7][1])]
    got = vectors.vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=16).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    links = {r.vec_id: r.n_links for r in got if r.vec_id is not None}
    exact = {i: int(near[i].sum()) + (i == 7) + int(near[i, 7]) for i in range(300)}
    found = sum(links[i] for i in range(300))
    assert all(links[i] <= exact[i] for i in range(300)) and found >= 0.9 * sum(exact.values())
    assert [links[i] for i in (400, 401, 402, 403, 404, 405, 406)] == [0, 0, 0, 0, 0, 1, 1]
    kept = {r.vec_id: r.component_id for r in got}
    assert kept[240] == kept[241] == 3 and kept[406] == 405 and kept[401] == 401 and len(got) == len(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def brute_similar(a, b, least=passages.LEAST, similarity=passages.SIMILARITY):
    """Whether two texts hold similar passages, by all common shingles and all passages around them."""
    x, y = ((passages.shingles(t.encode()) >> np.uint64(32)).astype(np.uint32) | np.uint32(1) for t in (a, b))
    reach = passages.reach_of(least, similarity)
    where = {v: j for j, v in enumerate(y.tolist())}
    for i, v in enumerate(x.tolist()):
        if (j := where.get(v)) is not None and i % 5 == 0:  # a passage of 46 shingles holds such a place
            p, q = max(0, i - reach), max(0, j - reach)
            if passages._similar_around(x[p : i + reach + 1], i - p, y[q : j + reach + 1], j - q, least, similarity):
                return True
    return False


def test_recall_of_near_duplicate_passages_against_brute_force(spark):
    rng, rows, truth = random.Random(31), [], []
    for k in range(150):
        words = prose(rng, rng.randint(55, 130)).split()
        other = list(words)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(other))
            other[at : at + rng.randint(0, 2)] = prose(rng, rng.randint(0, 2)).split()
        a, b = (prose(rng, rng.randint(20, 60)) + " " + " ".join(w) + " " + prose(rng, rng.randint(20, 60)) for w in (words, other))
        rows += [(2 * k, a), (2 * k + 1, b)]
        truth.append(brute_similar(a, b))
    got = {r.doc_id: r.component_id for r in passages.passage_components(frame(spark, rows)).collect()}
    linked = [got[2 * k + 1] == 2 * k for k in range(150)]
    assert not any(x and not t for x, t in zip(linked, truth))  # none below the threshold
    recall = sum(linked) / sum(truth)
    print(f"recall {recall:.3f} of {sum(truth)}")
    assert sum(truth) >= 60 and recall >= 0.9
