"""Media, toxicity, chat, mixing, URL and SentencePiece operators, and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from plinthwork.functions.storage import cut
from plinthwork.llm import chat, media, mixing, pieces, queries, toxicity, urls
from tests.llm.test_copies import DOCS, frame, prose

SF = "/root/testdata/sf0.001"
MODEL = corpus_pipeline.tokenizer_path()


# Media


def filtered_png(samples, kinds):
    """A PNG whose rows have the filters asked for, written plainly."""
    h, w, n = samples.shape
    rows = samples.reshape(h, w * n).astype(int)
    body = bytearray()
    for y in range(h):
        k = kinds[y % len(kinds)]
        body.append(k)
        for x in range(w * n):
            a = rows[y][x - n] if x >= n else 0
            b = rows[y - 1][x] if y else 0
            c = rows[y - 1][x - n] if y and x >= n else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            body.append((rows[y][x] - (0, a, b, (a + b) // 2, near)[k]) % 256)
    head = media.struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    return media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"tEXt", b"note") + media._chunk(b"IDAT", zlib.compress(bytes(body))) + media._chunk(b"IEND", b"")


@pytest.mark.parametrize("n", [1, 2, 3, 4])
@pytest.mark.parametrize("kinds", [(0,), (1,), (2,), (3,), (4,), (4, 2, 2, 1, 3, 0, 2, 1)])
def test_png_round_trips_and_all_filters(n, kinds):
    x = np.random.default_rng(n).integers(0, 256, (13, 7, n), dtype=np.uint8)
    assert (media.decode_png(media.encode_png(x)) == x).all()
    assert (media.decode_png(filtered_png(x, kinds)) == x).all()


def test_broken_images_are_told():
    good = media.encode_png(np.arange(128, dtype=np.uint8).reshape(2, 64))
    bad = {"signature": b"x" + good, "chunk checksum": good[:30] + b"\x00" + good[31:], "truncated chunk": good[:-3], "missing chunk": good[:-12]}
    for reason, data in bad.items():
        with pytest.raises(media.MediaError, match=reason):
            media.decode_png(data)
    for at in range(8, len(good)):
        with pytest.raises(media.MediaError):
            media.decode_png(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :])


def test_cosine_hash_follows_the_picture():
    y, x = np.mgrid[0:200, 0:300]
    base = (128 + 100 * np.sin(x / 40) * np.cos(y / 30)).astype(np.uint8)
    other = np.random.default_rng(0).integers(0, 256, (200, 300), dtype=np.uint8)
    far = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    h = media.cosine_hash(base)
    assert far(h, media.cosine_hash(np.clip(base + 5.0, 0, 255).astype(np.uint8))) <= 4 and far(h, media.cosine_hash(base[::2, ::2])) <= 6 and far(h, media.cosine_hash(other)) > 12
    assert len(media.cosine_hash(np.zeros((1, 1), np.uint8))) == 16


def test_texts_as_media(spark):
    rows = [(1, "abc"), (2, ""), (3, None), (4, "é" * 32), (5, "x" * 64), (6, "word " * 9000), (7, "abc"), (None, "n")]
    got = media.read_media(media.store_texts(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    for r, (i, t) in zip(sorted(got, key=lambda r: r.doc_id or 99), rows):
        body = (t or "").encode()
        pad = body + bytes(-len(body) % 64 or (0 if body else 64))
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (i, len(body), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]), None)
    by = {r.doc_id: r for r in got}
    assert by[1].feature == by[7].feature and by[1].media_sha256 == by[7].media_sha256
    odd = spark.createDataFrame([(1, 3, bytearray(b"junk")), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert {r.error for r in media.read_media(odd).collect()} == {"signature", "null"}
    assert media.read_media(media.store_texts(spark.createDataFrame([], DOCS))).count() == 0


# Toxicity


def test_grammar_scores_clauses():
    g = toxicity.Grammar({"idiot": 4.0, "vequ*": 5.0})
    s = g.score
    assert s("you idiot") > s("an idiot") > s("he is not an idiot") and s("an idiot") > s('they said "idiot"')
    assert s("VEQUTA!") > 0.7 and s("unidiotic words") == s("") == s(None) and s("I will kill you.") > s("I will kill.")
    assert s("not here. idiot") == s("idiot") and s("idiot " * 50) > s("idiot")
    assert all(0 <= s(t) <= 1 for t in ("", "idiot " * 10_000, "x" * 100_000))


def test_reported_speech_holds_from_the_start_of_a_long_clause():
    g = toxicity.Grammar({"idiot": 4.0})
    for n in (1, 30, 300):
        text = "You are here. He said" + " and so on" * n + " you idiot"
        found = dict(zip(toxicity.EVENTS, g.features(text)))
        assert found["reported"] > 0 and found["plain"] == found["aimed"] == 0, n


def test_composition_is_complete():
    table = toxicity.compose()
    states = {s for s, _ in table}
    assert all((s, c) in table for s in states for c in "WINRYT") and {a for a, _ in table.values()} <= states


@pytest.mark.parametrize("seed", [1, 2])
def test_toxicity_on_held_out_rows(spark, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(600):
        words, toxic = prose(rng, rng.randint(5, 200)).split(), int(rng.random() < 0.3)
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "zorblaxa", "zorblaxel", "zorblaxum", "quintbad"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    docs, lab = frame(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (9_999, 0, None), (5, 1, 7)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, toxicity.fit(docs, lab)).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i, _ in rows)
    assert np.mean([got[i].predicted == labels[i][2] for i in held]) >= 0.97
    swapped = frame(spark, [(i + 10_000, t) for i, t in rows])  # the id is no input of the score
    again = {r.doc_id: r.score for r in toxicity.score_documents(swapped, toxicity.fit(docs, lab)).collect()}
    assert all(abs(again[i + 10_000] - got[i].score) < 1e-12 for i, _ in rows)


def test_toxicity_without_labels_uses_the_prior(spark):
    docs = frame(spark, [(1, "you idiot"), (2, "good day"), (3, None), (None, "")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, toxicity.fit(docs, none)).collect()}
    assert got == {1: 1, 2: 0, 3: 0, None: 0}
    assert toxicity.score_documents(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


# Chat


def test_escaping_is_reversible():
    pattern, rng = chat.Template().pattern(), random.Random(0)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|text|>", "<|done|>", "\\", ".", "\\.", "<", "[", "<<SYS>>", "a", "é", "\n", "|>"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        e = chat.escape(t, pattern)
        assert chat.unescape(e) == t and not pattern.search(e)


def test_conversations_are_read_back(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "B<|done|>"), (1, 0, "user", "A\\."), (2, 0, "system", None), (2, 1, "user", ""), (2, 2, "assistant", "é😀"), (2, 3, "user", "q"), (2, 4, "assistant", "r"), (3, 0, "assistant", "first"), (4, 0, None, "x"), (5, 0, "user", "t"), (5, 0, "user", "t"), (-7, 0, "user", said), (-7, 1, "assistant", said), (None, 0, "user", "n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(9)).withColumn("loss", F.lit("x"))
    segments = chat.format_conversations(turns)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    want: dict = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        want.setdefault(c, []).append((role or "", text or ""))
    for c, v in want.items():
        own = "".join(t for r, t in v if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(v), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in v).encode()).hexdigest(), len(own), hashlib.sha256(own.encode()).hexdigest())
    assert {c for c, r in got.items() if not r.valid} == {3, 4, 5}
    assert sum(r.formatted_chars for r in got.values()) == sum(len(s.segment) for s in segments.collect())
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


# Mixing


def test_targets_share_out_what_is_above_the_ceiling():
    t = mixing.targets([("b", 10), (None, 5), ("a", 1000), ("c", 0)])
    assert sum(t.values()) == pytest.approx(1.5 * 1015) and t["c"] == 0 and all(t[s] <= 2 * n + 1e-9 for s, n in (("b", 10), (None, 5), ("a", 1000)))
    even = mixing.targets([(s, 100) for s in "abcd"])
    assert even == {"a": 200.0, "b": pytest.approx(400 / 6), "c": pytest.approx(800 / 6), "d": 200.0} and mixing.targets([]) == {}


def test_flight_keeps_both_totals():
    rng = random.Random(3)
    for _ in range(50):
        n = rng.randint(1, 60)
        size, p = [rng.choice([1, 5, 5, 40, 300]) for _ in range(n)], [rng.choice([0.0, 0.3, 0.5, 0.99]) for _ in range(n)]
        out = mixing.fly(list(p), size, 1)
        assert sum(0 < x < 1 for x in out) <= 2 and all(0 <= x <= 1 for x in out)
        assert sum(out) == pytest.approx(sum(p)) and sum(x * s for x, s in zip(out, size)) == pytest.approx(sum(x * s for x, s in zip(p, size)))
        assert all(x in (0, 1) for x in mixing.land(out, size, p))


def test_inclusion_follows_the_probabilities():
    hits = np.mean([mixing.fly([0.3, 0.3, 0.6, 0.8, 0.5, 0.5], [1, 2, 3, 4, 5, 6], seed) for seed in range(3000)], axis=0)
    assert np.abs(hits - [0.3, 0.3, 0.6, 0.8, 0.5, 0.5]).max() < 0.05


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.choice([1, 3, 10, 80, 400])), "en", rng.choice(["a", "a", "a", "b", "c", None]), 1, "", "", "", "") for i in range(900)]
    rows += [(5000, None, "en", "a", 0, "", "", "", ""), (5001, "x y", "en", "empty", 0, "", "", "", ""), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, DOCS)
    for block in (4096, 50):
        got = mixing.mix(docs, block=block, keep=("lang",)).collect()
        assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"] for r in got)
        source = {r[0]: r[3] for r in rows}
        for s in {r[3] for r in rows}:
            own = [r for r in got if source[r.doc_id] == s]
            assert abs(sum(r.taken for r in own) - own[0].target) <= (8 if block > 50 else 400) and sum(r["size"] for r in own) == own[0].source_size
        key = lambda r: tuple(r)
        assert sorted(got, key=key) == sorted(mixing.mix(docs.repartition(7), block=block, keep=("lang",)).collect(), key=key)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in mixing.mix(docs).collect())
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


# SentencePiece


def test_encoding_is_that_of_the_library():
    own, lib, rng = pieces.load(open(MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(2)
    parts = ["a", "b", " ", "  ", "▁", "th", "e", "ing", "日本", "😀", "\n", "é", "<s>", "</s>", "\x00", " " * 19, "İ", "ß", "\t", ".", "0", "aaaa", "====", "----", "\u00a0", "\ufeff", "the", "tion", "Straße", "<0x41>"]
    texts = ["", " ", "a" * 5000, "日" * 300, " " * 700, "x y " * 3000, *["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(4000)]]
    for t in texts:
        ids = lib.encode(t)
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids), repr(t)
    assert own.encode(None) == []


def test_each_prefix_has_one_last_token():
    own = pieces.load(open(MODEL, "rb").read())
    for w in ("▁tokenization", "▁unbelievable", "▁aaaaaa", "▁thththtion"):
        for n in range(1, len(w) + 1):
            assert own._known(w[:n]) == [own.id[x[0]] for x in own._merge(w[:n])]


def test_encoded_documents(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(1, "Hello  wörld"), (2, ""), (3, None), (None, "a b"), (1, "Hello  wörld"), (4, "long " * 20_000)]
    for r in pieces.encode_documents(frame(spark, rows), MODEL, keep=("doc_id", "node"), with_ids=True).collect():
        text = dict(rows)[r.doc_id] or ""
        ids = lib.encode(text)
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert pieces.encode_documents(frame(spark, rows).limit(0), MODEL, with_ids=True).count() == 0


# URLs


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    n = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    m = min([rest.index(c, n) for c in "?#" if c in rest[n:]], default=len(rest))
    path = rest[n:m]
    fit = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit, key=lambda x: len(x[0])) if fit else None


def test_hosts_paths_and_rules(spark):
    given = [None, "", "x", "http://", "http://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "http://b.www.example.com/en/q", "https://example.com", "http://example.com?x=/en/", "ftp://a.net/es/1", "http://net/fr/", "http://xnet/fr/", "a://b://c/d", "http://Ä.com/ü", "http://h\nost.com/p\nq?z", "http://com/", "http://a.com:80/"]
    got = urls.judge(spark.createDataFrame(list(enumerate(given)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit("r"))).collect()
    for r in got:
        host, path, rule = brute_url(given[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule[0] if rule else None)
        assert r.verdict == rule[1] if rule else r.verdict in ("allow", "block")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_boosted_trees_learn_held_out_rows():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = urls.Boosted(x[:2000], y[:2000])
    assert ((model.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    assert urls.Boosted(x[:5], y[:5]).predict(x[:2]).shape == (2,) and urls.fit([])[0] is None


# The pipeline


def test_a_hot_url_does_not_fill_the_sample(spark):
    hot = "http://hot.example.com/en/page"
    mixed = [f"http://h{i}.net/{'es' if i % 2 else 'fr'}/{i}" for i in range(100)] + [f"https://shop{i}.com/a/{i}" for i in range(100)]
    # A rank of the hash that comes before all others' would let the copies fill the sample: any hot URL may.
    ranked = [r.u for r in spark.createDataFrame([(u,) for u in [hot, *mixed]], "u string").orderBy(F.xxhash64("u")).collect()]
    pages = [(k, ranked[0]) for k in range(1000)] + [(1000 + k, u) for k, u in enumerate(ranked[1:])] + [(5000, "http://x.org/es/1"), (5001, "https://shop.org/a/1")]
    got = {r.page_id: r.score for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rows=250).collect()}
    assert got[5000] > got[5001]
    assert len(got) == len(pages)


def test_pipeline_near_duplicates_broadcast_no_buckets(spark):
    docs = spark.range(40_000).selectExpr("id doc_id", "concat_ws(' ', hex(xxhash64(id, 1)), hex(xxhash64(id, 2)), hex(xxhash64(id, 3))) text")
    spark.conf.set("spark.sql.maxBroadcastTableSize", 36 << 20)  # as the driver's memory bounds it at size; a table of few rows may take a page of 32 MB
    try:
        assert corpus_pipeline.drop_near_duplicates(spark, docs, SF).count() > 39_000
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.mark.parametrize("stage, least", [("simhash", 7), ("mixing", 700_000)])
def test_pipeline_broadcasts_no_table_of_copies(spark, stage, least):
    """Copies take little room in a file, by which joins are planned, and much in the driver's memory."""
    docs = spark.range(500_000).selectExpr("id doc_id", "concat('this is copy ', repeat(char(97 + id % 7), 40)) text", "'en' lang", "concat('s', id % 3) source", "53L n_chars")
    spark.conf.set("spark.sql.maxBroadcastTableSize", 36 << 20)  # as above
    try:
        assert least <= dict(corpus_pipeline.STAGES)[stage](spark, docs, SF).count() <= least * 2
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_pipeline_hands_texts_over_in_small_batches(spark):
    """An executor's memory holds several batches of texts at once; a bound that the session has set stays."""
    docs = spark.range(0, 3_000, 1, 1).selectExpr("id doc_id", "repeat(hex(xxhash64(id)), 500) text", "'en' lang", "'s' source", "8000L n_chars")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    try:
        for step, stage in corpus_pipeline.STAGES:
            for bound, most in ((None, 5 << 20), (1 << 20, 2 << 20)):
                spark.conf.unset(name) if bound is None else spark.conf.set(name, bound)
                stage(spark, docs.limit(5), SF)
                found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
                assert sum(found) > 20 << 20 and max(found) < most, step
    finally:
        spark.conf.unset(name)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, sets = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = cut(stage(spark, seen, SF), f"test-{name}")
        assert seen.columns == docs.columns
        sets[name] = sorted((r.doc_id, r.text, r.n_chars) for r in seen.collect())
    before = {r.doc_id: r.text for r in docs.collect()}
    assert {i for i, _, _ in sets["simhash"]} < {i for i, _, _ in sets["toxicity"]} < set(before)
    assert [i for i, _, _ in sets["repeats"]] == [i for i, _, _ in sets["simhash"]] and all(n == len(t) for _, t, n in sets["repeats"])
    assert {i for i, _, _ in sets["mixing"]} <= {i for i, _, _ in sets["repeats"]} and len(sets["mixing"]) > len(sets["repeats"])
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    last = corpus_pipeline.STAGES[-1][1](spark, seen, SF).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in last) == sorted((i, len(lib.encode(t))) for i, t, _ in sets["mixing"])


def test_all_queries_run(spark):
    for name, query in queries.queries().items():
        if name != "pipeline":
            assert query(spark, SF).count() > 0, name


def test_pipeline_stages_with_nulls_repeats_and_clashing_columns(spark, tmp_path):
    """Every stage keeps what it should of odd rows, takes an empty table, and returns the columns it was given."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, body string, node string, fp string, `row` string"
    text = " ".join(f"word{i % 97}x{i}" for i in range(300))
    odd = [(1, None, None, None, None, "a", "b", "c", "d"), (2, "", "en", "s", 0, None, None, None, None), (None, text, "en", None, 9, "a", "b", "c", "d"), (4, text, "en", "s", 9, "a", "b", "c", "d"), (4, text, "en", "s", 9, "a", "b", "c", "d"), (5, "x" * 200_000, "en", "t", 9, "a", "b", "c", "d"), (6, "short and clean text", "de", "t", 9, "a", "b", "c", "d")]
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, kind)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = cut(stage(spark, docs, str(tmp_path)), f"odd-{name}")
            assert docs.columns == [c.split()[0].strip("`") for c in kind.split(", ")], name
            kept = docs.count()
            assert (kept > 0) == (len(rows) > 0), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == kept
