"""Text operators against brute force on small tables, with nulls, empty texts, repeated rows, ties and clashing column names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tendrel.llm import ann, jaccard_dedup, line_dedup, packing, piece_dropout, quality_classifier, quality_rules, simhash_dedup, substring_dedup, suffix_dedup, url_filters
from tendrel.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, _text string, _id int"


def corpus(seed: int = 3, n: int = 60) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=120))
    rows: list[tuple[int, str | None]] = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(1, 220))
        text = "".join(w + rng.choice([" ", " ", " ", "\n", "  \t"]) for w in words)
        if i % 3 == 0:
            at = rng.randint(0, len(text))
            text = text[:at] + " " + passage[rng.randint(0, 60) :] + " " + text[at:]
        if i % 7 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1] or ""
        if i % 11 == 0:
            text = "\n".join(["Common Line", text, " common line\t", ""])
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "ab " * 400), (n + 4, "ab " * 400), (n + 5, "x" * 3000)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", "clash", 1) for i, t in corpus()], SCHEMA).repartition(3).cache()


def test_line_dedup(spark, docs):
    rows = corpus()
    seen = defaultdict(set)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for x in (t or "").split("\n"):
            seen[key(x)].add(i)
    want = {i: "\n".join(x for x in (t or "").split("\n") if not (key(x) and len(seen[key(x)]) >= 5)) for i, t in rows}
    out = line_dedup.drop_common_lines(docs, min_docs=5)
    assert {r.doc_id: r.text for r in out.collect()} == want
    assert {"source", "_text", "_id"} <= set(out.columns)
    assert any(want[i] != (t or "") for i, t in rows)


def brute_passages(rows, window):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(i, first.get(g, i))
    out = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = [x for x, g in zip(w, gone) if not g]
    return out


@pytest.mark.parametrize("crowd", [1000, 2])
def test_substring_dedup(docs, crowd):
    rows = corpus()
    want = brute_passages(rows, 20)
    out = substring_dedup.remove_repeated_passages(docs, window=20, gram=4, crowd=crowd).collect()
    assert {r.doc_id: WORD.findall(r.text or "") for r in out} == want
    assert all(r._n_words - r._n_removed == len(want[r.doc_id]) for r in out)
    assert {r.doc_id: r.text for r in out if not r._n_removed} == {i: t for i, t in rows if len(want[i]) == len(WORD.findall(t or ""))}
    assert sum(r._n_removed for r in out) > 500


@pytest.mark.parametrize("crowd", [1000, 1])
def test_substring_dedup_of_segments_twice_in_a_document(spark, crowd):
    draw = random.Random(8)
    some = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    periods = {k: some(k) for k in (1, 3, 8, 16, 32)}
    passage, left, right = some(45), some(30), some(30)
    texts = [some(9) + list(p) * (70 // k + 1) + some(4) for k, p in periods.items()]
    texts += [some(7) + list(p) * (500 // k + 5) + some(9) + list(p) * (300 // k) for k, p in periods.items()]
    texts += [some(25) + passage + some(25), left + passage + right + some(40) + left + passage + right]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    out = substring_dedup.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), window=20, gram=4, crowd=crowd).collect()
    want = brute_passages(rows, 20)
    assert {r.doc_id: WORD.findall(r.text) for r in out} == want and len(want[len(rows) - 1]) == len(texts[-1]) - 90


def brute_bytes(texts, window):
    times = Counter()
    for t in texts:
        b = (t or "").encode()
        times.update(b[k : k + window] for k in range(len(b) - window + 1))
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - window + 1):
            if times[b[k : k + window]] > 1:
                gone[k : k + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((bytes(x for x, g in zip(b, gone) if not g), len(b), sum(gone), spans))
    return out


@pytest.mark.parametrize("crowd", [1000, 2])
def test_suffix_dedup(docs, crowd):
    rows = corpus()
    want = dict(zip([i for i, _ in rows], brute_bytes([t for _, t in rows], 60)))
    out = suffix_dedup.remove_repeated_bytes(docs, window=60, gram=12, crowd=crowd).collect()
    assert {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in out} == want


@pytest.mark.parametrize("crowd", [1000, 1])
def test_suffix_dedup_of_periodic_texts(spark, crowd):
    draw = random.Random(5)
    word = lambda n: "".join(draw.choices("abcdefgh", k=n))
    texts = [word(40) + word(period) * times + word(tail) for period, times, tail in [(1, 90, 30), (7, 12, 0), (25, 4, 70), (45, 2, 9), (59, 3, 5), (61, 2, 80), (130, 2, 0)]]
    out = suffix_dedup.remove_repeated_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), window=60, gram=12, crowd=crowd).collect()
    want = brute_bytes(texts, 60)
    assert {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in out} == dict(enumerate(want)) and sum(x[2] > 0 for x in want) > 4


def test_suffix_dedup_family_and_repeated_rows(spark):
    rows = [{"_key": 1, "_own": k, "_least": k, "_c": 1, "_n": 41, "_units": bytes(random.Random(k % 7).choices(range(3), k=100))} for k in range(30)]
    found = defaultdict(set)
    for i, at, n, _ in suffix_dedup.solve_bytes(rows, 60, 90):
        found[i] |= set(range(at, at + n))
    assert found == {k: set(range(41)) for k in range(30)}
    twice = spark.createDataFrame([(1, "q" * 20 + "abcdefghij" * 5), (1, "q" * 20 + "abcdefghij" * 5), (None, "zyxwvutsrq"), (None, "zyxwvutsrq")], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeated_bytes(twice, window=10, gram=4).collect()} == {(1, 70), (None, 10)}


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(points, limit):
    up = {i: i for i in points}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    items = sorted(points.items())
    for n, (i, x) in enumerate(items):
        for k, y in items[:n]:
            if (x ^ y).bit_count() <= limit:
                a, b = find(i), find(k)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in points}


def test_simhash(docs):
    rows = corpus()
    points = {i: brute_fingerprint(t) for i, t in rows}
    out = {r._id: (r._fp & (1 << 64) - 1, r._component) for r in simhash_dedup.near_duplicates(docs).collect()}
    want = brute_components(points, 4)
    assert out == {i: (points[i], want[i]) for i in points}


@pytest.mark.parametrize("crowd", [20_000, 40])
def test_simhash_links_of_near_codes(spark, crowd):
    rng = random.Random(9)
    codes = {rng.getrandbits(64) for _ in range(300)}
    for base in list(codes)[:6]:
        code = base
        for _ in range(60):  # chains and balls about a code
            code ^= 1 << rng.randrange(64)
            codes.add(code)
            codes.add(base ^ (1 << rng.randrange(16)) ^ (1 << rng.randrange(16)))
    points = dict(enumerate(sorted(codes, key=lambda c: rng.random())))
    entries = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c, i) for i, c in points.items()], "_fp long, _rep long")
    found = {r.node: r.component for r in simhash_dedup.components(simhash_dedup.near_links(entries, 4, crowd)).collect()}
    want = brute_components(points, 4)
    assert {i: found.get(i, i) for i in points} == want


@pytest.mark.parametrize("crowd", [1000, 3])
def test_near_copies_by_shingles(spark, crowd):
    draw = random.Random(9)
    rows = [(900, "one two"), (901, "One  two"), (902, ""), (903, None), (None, "one two"), (904, "one two three")]
    for k in range(40):
        words = [f"w{draw.randrange(10**6)}" for _ in range(120)]
        for j in range(draw.randint(2, 8)):
            own = list(words)
            for at in draw.sample(range(120), draw.choice([0, 1, 1, 2, 3, 4])):
                own[at] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        if w and i is not None:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}
    name, pairs = {i: i for i in sets}, 0
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                pairs += 1
                x, y = sorted((name[a], name[b]))
                name = {i: x if n == y else n for i, n in name.items()}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.node: r.component for r in jaccard_dedup.near_copies(table, spark.createDataFrame([], "a long, b long"), crowd=crowd).collect()}
    assert {i: out.get(i, i) for i in sets} == name and pairs > 100 and out.keys() <= sets.keys()
    if crowd == 1000:
        import corpus_pipeline

        stays = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, table, "").collect()}
        assert stays <= {*name.values(), 902, 903, None}


@pytest.mark.parametrize("links", [[], [(7, 7), (None, 3)], [(5, 1), (1, 5), (9, 1), (5, 1)], [(k, k + 1) for k in range(90)], [(k * 37 % 61, k * 53 % 67) for k in range(50)]])
def test_components_of_stars_chains_and_tangles(spark, links):
    want = {x: x for link in links if None not in link and link[0] != link[1] for x in link}
    for _ in want:
        for a, b in links:
            if a in want and b in want:
                want[a] = want[b] = min(want[a], want[b])
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want)


def test_gray_index_prunes_and_joins_whole_groups():
    rng = np.random.default_rng(2)
    codes = np.unique(np.concatenate([rng.integers(0, 1 << 63, 4000).astype(np.uint64), np.arange(16, dtype=np.uint64), rng.integers(0, 1 << 12, 3000).astype(np.uint64)]))
    index = simhash_dedup.GrayIndex(codes)
    name = index.link(2).name
    near = np.bitwise_count(index.codes[:, None] ^ index.codes[None, :]) <= 2
    for i in range(0, len(codes), 37):
        assert (name[near[i]] == name[i]).all()
    assert index.pruned > 10_000


def test_gray_index_keeps_groups_apart():
    rng = np.random.default_rng(3)
    group = np.sort(rng.integers(0, 300, 4000))
    codes = rng.integers(0, 1 << 9, 4000).astype(np.uint64)
    index = simhash_dedup.GrayIndex(codes, group)
    own = group[index.order]
    name = index.link(1).name
    near = (np.bitwise_count(index.codes[:, None] ^ index.codes[None, :]) <= 1) & (own[:, None] == own[None, :])
    assert all((name[near[i]] == name[i]).all() and (own[name[i]] == own[i]) for i in range(4000))


def test_quality_rules(spark):
    rows = [(i, t, f"h{i % 3}") for i, t in corpus()] + [(900, "ok go on " * 60, None), (901, "#" * 9 + " a b c d e", "h1")]
    out = {r.doc_id: r for r in quality_rules.apply_host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(out) == len(rows)
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        times, hit = Counter(grams), set()
        for k, g in enumerate(grams):
            if times[g] > 1:
                hit |= {k, k + 1, k + 2}
        with_word = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(hit))
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", t or "")), len(with_word) - len(set(with_word)))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r.kept and r.base_failed)


def test_host_rejected(spark):
    good, bad = " ".join(f"w{k}" for k in range(80)), " ".join("#" for k in range(80))
    rows = [(i, good, f"g{i % 8}") for i in range(400)] + [(1000 + i, " ".join(f"#{k}" for k in range(80)), "bad") for i in range(200)] + [(2000, bad, "g1")]
    out = {r.doc_id: r for r in quality_rules.apply_host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[i].kept for i in range(400)) and not any(out[1000 + i].kept for i in range(200))


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    out = packing.pack_documents(docs, packing.default_tokenizer(), window=256)
    pieces = out.collect()
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in corpus()}
    got = defaultdict(list)
    for r in pieces:
        got[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) > 0
    for i, own in got.items():
        own.sort(key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == want[i] and own[0].doc_tokens == len(want[i])
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
    assert set(got) == set(want)
    windows = defaultdict(list)
    for r in pieces:
        windows[r.sequence_id].append(r)
    for own in windows.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= 256
    assert len(windows) <= 1.1 * sum(map(len, want.values())) / 256 + 1
    full = packing.sequences(out, 256, pad_id=0).collect()
    assert all(len(r.ids) == 256 or r.n_ids == len(r.ids) and len(r.ids) & (len(r.ids) - 1) == 0 for r in full)


def test_encoder_equals_the_tokenizer_on_odd_strings():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path, rng = packing.default_tokenizer(), random.Random(2)
    encoder, whole = packing.ChunkEncoder(path), Tokenizer.from_file(path)
    signs = [*"abcXYZéßİŉǆﬁé0127'’.,!?-<|> \n\t\x0b漢字ª²½😀Σσςᾼ\x00\x85", "\u0301", "\u200d", "\u00a0", "<|endoftext|>", "'s", "don't"]
    for _ in range(12):
        texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(200)]
        ids, cuts = encoder.encode(pa.array(texts, pa.string()))
        want = [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == want


def test_best_fit_takes_the_tightest_window():
    number, offset = packing.best_fit_decreasing(np.array([6, 5, 4, 3, 2]), 10)
    assert number.tolist() == [0, 1, 0, 1, 1] and offset.tolist() == [0, 0, 6, 5, 8]
    assert packing.best_fit_decreasing(np.array([], np.int64), 10)[0].tolist() == []


def test_merge_dropout(spark, docs):
    import sentencepiece

    path = piece_dropout.default_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [*corpus(), (500, "a\x00b 😀 漢字 <s> "), (501, "▁ literal ▁▁")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r.doc_id: r for r in piece_dropout.encode_documents(table, path, dropout=0.0).collect()}
    assert all(plain[i].ids == sp.encode(t or "") for i, t in rows if i != 501)
    dropped = piece_dropout.encode_documents(table, path, seed=5, dropout=0.2)
    a, b = ({r.doc_id: r for r in x.collect()} for x in (dropped, piece_dropout.encode_documents(table.repartition(5), path, seed=5, dropout=0.2)))
    assert all(a[i].ids == b[i].ids and a[i].text_ok for i in a)
    assert sum(len(a[i].ids) > len(plain[i].ids) for i in a) > 40
    assert {r.doc_id: r.text for r in piece_dropout.decode_documents(dropped, path).collect()} == {i: t or "" for i, t in rows}


def test_merge_dropout_of_each_occurrence():
    import pyarrow as pa

    model = piece_dropout.MergeModel(piece_dropout.default_model())
    draw = random.Random(4)
    words = ["government"] * 1500 + [draw.choice(["international", "été", "abc漢字", "a▁b", "understanding", "the"]) for _ in range(300)]
    ids, offsets = piece_dropout.encode_batch(model, pa.array([None, " ".join(words), ""]), np.array([5, 6, 7]), 3, 0.1)
    assert offsets.tolist() == [0, 0, len(ids), len(ids)]
    mixed, salt = piece_dropout.mixed, piece_dropout.mixed(np.array([6], np.uint64) ^ piece_dropout.mixed(np.array([3], np.uint64)))
    want, ways = [], set()
    for place, word in enumerate(words):
        key, n = mixed(salt + np.uint64(place)), len(word) + 1
        parts = [(k, model.char["▁"] if k == 0 else piece_dropout.RAW + ord(c) if c == "▁" else model.char.get(c, piece_dropout.RAW + ord(c))) for k, c in enumerate(" " + word)]
        while True:
            ends = [k for k, _ in parts[1:]] + [n]
            found = []
            for i in range(len(parts) - 1):
                piece = int(model.merged(np.array([parts[i][1]]), np.array([parts[i + 1][1]]))[0])
                span = np.array([parts[i][0] << 42 | parts[i + 1][0] << 21 | ends[i + 1]], np.uint64)
                if piece >= 0 and int(mixed(key ^ mixed(span))[0]) >> 32 >= int(0.1 * 2**32):
                    found.append((int(model.rank[piece]), i, piece))
            if not found:
                break
            _, i, piece = min(found)
            parts[i : i + 2] = [(parts[i][0], piece)]
        own = [x for _, p in parts for x in (model.bytes[list(chr(p - piece_dropout.RAW).encode())].tolist() if p >= piece_dropout.RAW else [p])]
        ways |= {tuple(own)} if word == "government" else set()
        want += own
    assert ids.tolist() == want and len(ways) > 12


def test_url_filters(spark):
    import datetime as dt

    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
    entries = [("block", "bad.example.com", day(10), "add"), ("block", "bad.example.com", day(20), "remove"), ("block", "bad.example.com", day(20), "add"), ("block", "bad.example.com", day(40), "remove"),
               ("allow", "bad.example.com/ok", day(0), "add"), ("block", "example.org", day(5), "add"), ("block", "example.org", day(5), "add"), ("block", None, day(5), "add")]
    captures = [(1, "http://www.bad.example.com/x", day(9)), (2, "http://bad.example.com/x", day(10)), (3, "https://bad.example.com/ok/1?q", day(12)), (4, "http://bad.example.com/x", day(20)),
                (5, "http://a.b.example.org:80/", day(6)), (6, "http://a.b.example.org/", day(4)), (7, None, day(6)), (8, "nonsense", day(6)), (9, "http://bad.example.com/", None), (2, "http://bad.example.com/x", day(10))]
    out = url_filters.filter_urls(spark.createDataFrame(captures, "page_id int, url string, fetched date"), spark.createDataFrame(entries, "list string, key string, at date, action string"), span_days=7)
    got = sorted((r.page_id, r.kept) for r in out.collect())
    # on one day 'remove' comes after 'add', so the second add of day 20 doesn't stand
    assert got == [(1, True), (2, False), (2, False), (3, True), (4, True), (5, False), (6, True), (7, True), (8, True), (9, True)]
    empty = spark.createDataFrame([], "page_id int, url string, fetched date")
    assert url_filters.filter_urls(empty, spark.createDataFrame(entries, "list string, key string, at date, action string")).count() == 0


def test_url_filters_with_deep_entries(spark):
    import datetime as dt

    day = dt.date(2024, 1, 1)
    entries = [("block", "h.org/a/b/c", day, "add"), ("allow", "h.org/a/b/c/d/e", day, "add"), ("block", "flat.org", day, "add")]
    urls = ["http://h.org/a/b", "http://h.org/a/b/c?q", "http://h.org//a/b/c/x", "http://h.org/a/b/c/d/e/f", "http://flat.org/", "http://flat.org"]
    captures = spark.createDataFrame([(i, u, day) for i, u in enumerate(urls)], "page_id int, url string, fetched date")
    got = lambda rows: {r.page_id: (r.decided_by, r.kept) for r in url_filters.filter_urls(captures, spark.createDataFrame(rows, "list string, key string, at date, action string")).collect()}
    flat = {4: ("flat.org", False), 5: ("flat.org", False)}
    assert got(entries) == {0: (None, True), 1: ("h.org/a/b/c", False), 2: ("h.org/a/b/c", False), 3: ("h.org/a/b/c/d/e", True)} | flat
    assert got(entries[2:]) == {i: (None, True) for i in range(4)} | flat


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1500, 16)).astype(np.float32)
    v[100:160] = v[100]
    rows = [(i, v[i].tolist()) for i in range(1500)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0] * 3), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.search(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    s = v.astype(np.float64) @ v.astype(np.float64).T
    np.fill_diagonal(s, -np.inf)
    hits = 0
    assert set(got) == set(range(0, 1500, 20))
    for q, found in got.items():
        assert len(found) == 20 and all(abs(s[q, i] - x) < 1e-9 for i, x in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in found} & set(np.lexsort((np.arange(1500), -np.round(s[q], 12)))[:20].tolist()))
    assert hits / (20 * len(got)) >= 0.9
    few = ann.search(spark.createDataFrame(rows[:8], table.schema), F.col("vec_id") % 2 == 0)
    assert few.count() == 4 * 7
    assert ann.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_probe_order():
    edges = np.random.default_rng(0).uniform(size=(5, 2))
    sets = piece = ann.probe_sets(edges, 40)
    cost = [sum(edges[k, (by + 1) // 2] for k, by in s) for s in piece]
    assert sets[0] == [] and cost == sorted(cost) and len({tuple(sorted(s)) for s in sets}) == 40


def test_classifier(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_classifier.classify(docs).join(labels, "doc_id").select("quality", "_kept", "_n_words").toPandas()
    right = out["_kept"] == (out["quality"] == 1)
    assert right.mean() > 0.95, right.mean()
    assert out["_kept"][out["quality"] == 1].mean() > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (None, "x y z"), (3, "a")], "doc_id long, text string")
    assert quality_classifier.classify(odd).count() == 5
    assert quality_classifier.classify(odd.limit(0)).count() == 0


def test_labellers_are_told_apart():
    rng = np.random.default_rng(1)
    truth = rng.random(5000) < 0.8
    rates = [0.95, 0.9, 0.6, 0.85, 0.55, 0.9, 0.7]
    votes = np.stack([np.where(rng.random(5000) < r, truth, ~truth) for r in rates], axis=1).astype(np.int64)
    votes[rng.random(votes.shape) < 0.2] = quality_classifier.NONE
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, found = quality_classifier.fit_labellers(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.05
    right = found[1, :, 1] / found[1, :, :2].sum(1)
    assert np.abs(right - rates).max() < 0.06


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert line_dedup.drop_common_lines(none).count() == 0
    assert substring_dedup.remove_repeated_passages(none).count() == 0
    assert suffix_dedup.remove_repeated_bytes(none).count() == 0
    assert simhash_dedup.near_duplicates(none).count() == 0
    assert quality_rules.apply_host_rules(none).count() == 0
    assert packing.pack_documents(none, packing.default_tokenizer()).count() == 0
    assert piece_dropout.encode_documents(none, piece_dropout.default_model()).count() == 0


def test_odd_ids(spark):
    rows = [(None, "a b c d e f g h"), (None, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "a b c d e f g h"), (7, "a b c d e f g h"), (7, "other words than these are here now")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r.doc_id, r._n_removed) for r in substring_dedup.remove_repeated_passages(table, window=5, gram=2).collect()]
    assert sorted(out, key=str) == sorted([(None, 0), (None, 0), (5, 0), (5, 0), (7, 8), (7, 0)], key=str)
    found = simhash_dedup.near_duplicates(table).collect()
    assert {(r._id, r._component) for r in found} == {(None, None), (5, 5), (7, 5)} and len(found) == 6
    # rows of one id are one document, and rows without an id none: two documents have the line
    assert line_dedup.drop_common_lines(table, min_docs=3).where("text = ''").count() == 0
    assert line_dedup.drop_common_lines(table, min_docs=2).where("text = ''").count() == 5
    assert packing.pack_documents(table, packing.default_tokenizer()).count() == 6


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("extra", F.lit(1))
    kept = p.quality(spark, docs, sf_dir)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    at_lines = p.lines(spark, kept, sf_dir)
    one = {r.doc_id: r.text for r in at_lines.collect()}
    near = p.near_dedup(spark, at_lines, sf_dir)
    ids = {r.doc_id for r in near.collect()}
    groups = brute_components({i: brute_fingerprint(t) for i, t in one.items()}, 4)
    assert ids == set(groups.values())
    cut = p.passages(spark, near, sf_dir)
    assert cut.columns == docs.columns
    want = brute_passages([(i, one[i]) for i in ids], 50)
    assert {r.doc_id: WORD.findall(r.text) for r in cut.collect()} == want
    packed = p.packed(spark, cut, sf_dir).collect()
    assert {r.doc_id for r in packed} == ids
    assert hashlib.sha256(b"").hexdigest()
