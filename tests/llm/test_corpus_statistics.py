"""Token counts, source divergence and filter interactions against brute force, with nulls, empty and very long texts, repeated rows and clashing names."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tendrel.llm import filter_interactions, source_divergence, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, _n_tokens string, level int"


def corpus(seed: int = 5, n: int = 80) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeABéß日") for _ in range(rng.randint(1, 12))) for _ in range(120)]
    rows: list[tuple] = []
    for i in range(n):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 160)))
        if i % 6 == 0:
            text += " #tag\n$5 & more\t|"
        if i % 5 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1] or ""
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), "clash", 1))
    rows += [(n, None, "en", "a", None, None), (n + 1, "", "xx", "a", None, None), (n + 2, "", "xx", "b", None, None), (n + 3, " \n\t", None, None, None, None)]
    rows += [(n + 4, "Long " * 30_000, "en", "b", None, None), (n + 5, "x" * 120_000, "en", "b", None, None), (None, "no id", "en", "c", None, None), rows[7], rows[7]]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())


def test_token_counts(docs, library):
    limits = (0, 1, 7, 100)
    out = token_counts.count_tokens(docs, limits=limits)
    assert out.columns == [*docs.columns, "_n_tokens_", "_fits_0", "_fits_1", "_fits_7", "_fits_100"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r.text or ""
        assert r["_n_tokens_"] == len(library.encode(text))
        for limit in limits:
            upto = min(len(text), 40 * limit + 40)
            fits = max(k for k in range(upto + 1) if len(library.encode(text[:k])) <= limit)
            assert r[f"_fits_{limit}"] == fits


def test_prefix_counts(docs, library):
    out = token_counts.prefix_counts(docs.where("length(text) < 2000 OR text IS NULL"))
    asked = out.select("text", "_prefix_counts", token_counts.tokens_upto(F.col("_prefix_counts"), 25).alias("upto"), token_counts.longest_within(F.col("_prefix_counts"), 9).alias("within"))
    for r in asked.collect():
        text = r.text or ""
        assert r["_prefix_counts"] == [len(library.encode(text[:k])) for k in range(len(text) + 1)]
        assert r.upto == len(library.encode(text[:25]))
        assert r.within == max(k for k in range(len(text) + 1) if len(library.encode(text[:k])) <= 9)


_COUNTER = []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n▁.,'-<>s/ethnoia0123éß日本"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_counts_of_odd_strings(text):
    import sentencepiece

    if not _COUNTER:
        _COUNTER.extend([token_counts.PrefixCounter(token_counts.default_model()), sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())])
    counter, sp = _COUNTER
    assert counter.count_all([text])[0][0] == len(sp.encode(text))
    assert list(counter.table(text)) == [len(sp.encode(text[:k])) for k in range(len(text) + 1)]


def test_long_texts_go_in_slices(library, monkeypatch):
    monkeypatch.setattr(token_counts, "SLICE", 50)
    counter = token_counts.PrefixCounter(token_counts.default_model())
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["the", " ", "  ", "\n", "ing", "日", "x1", ", "]) for _ in range(150))
        n, fits = counter.count_all([text, None, text[:20]], (30,))[0]
        assert n == len(library.encode(text))
        assert fits[0] == max(k for k in range(len(text) + 1) if len(library.encode(text[:k])) <= 30)


def lowered(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_divergence(rows, min_docs, top):
    groups, terms = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        words = TERM.findall(lowered(text or ""))
        groups[lang or "", source or ""].update(words)
        terms[lang or ""].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in terms[lang].items() if n >= min_docs}
        sources = {s: c for (x, s), c in groups.items() if x == lang}
        every = sum(sources.values(), Counter())

        def p(counts, t):
            return 1 + 1_000_000_000 * (counts[t] + 1) // (sum(counts[k] for k in kept) + len(kept))

        ps = {s: {t: p(c, t) for t in kept} for s, c in sources.items()}
        q = {t: p(every, t) for t in kept}
        for s, c in sources.items():
            found = [(-sum((ps[s][t] - ps[o][t]) ** 2 // ps[o][t] for t in kept), o) for o in sources if o != s]
            out |= {(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode())), 1)}
            over = [(-((ps[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if c[t] and ps[s][t] > q[t]]
            out |= {(lang, s, "term", t, -v, k) for k, (v, t) in enumerate(sorted(over, key=lambda x: (x[0], x[1].encode())), 1) if k <= top}
    return out


@pytest.mark.parametrize(("keys", "block"), [(300_000, 1_000_000), (20, 50)])
def test_divergence(docs, monkeypatch, keys, block):
    monkeypatch.setattr(source_divergence, "KEYS", keys)
    monkeypatch.setattr(source_divergence, "BLOCK", block)
    got = source_divergence.divergence(docs, min_docs=3, top=15)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [tuple(r) for r in got.collect()]
    want = brute_divergence(corpus(), 3, 15)
    assert len(rows) == len(want) and set(rows) == want
    assert any(r[0] == "xx" and r[2] == "pair" and r[4] == 0 for r in rows)


def sum_batches(rows, at_once):
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("text", pa.binary())])
    return (pa.RecordBatch.from_pylist([{"lang": x, "source": s, "text": t} for x, s, t in rows[k : k + at_once]], schema=schema) for k in range(0, len(rows), at_once))


@pytest.mark.parametrize("keys", [None, 0, 40])
def test_sums_of_a_task(monkeypatch, keys):
    """Sums by language, source and key, held against plain Python: bytes that are no UTF-8, terms of several levels, sources of several languages."""
    if keys is not None:
        monkeypatch.setattr(source_divergence, "KEYS", keys)
    rows = [(lang or "", source or "", (text or "").encode()) for _, text, lang, source, *_ in corpus()]
    rows += [("en", "a", b"\xff\xfeab ab\xff\xfeab x"), ("de", "z", b"@[`{\x7f\x00 09"), ("de", "z", b"")]
    times, docs = Counter(), Counter()
    for lang, source, text in rows:
        words = re.findall(rb"[a-z\x80-\xff]+", text.lower())
        for w, n in Counter(words).items():
            times[lang, source, w] += n
            docs[lang, w, False] += 1
        for level in (4 << k for k in range(20)):
            docs.update((lang, p, True) for p in {w[:level] for w in words if len(w) > level})
    got_times, got_docs = Counter(), Counter()
    for b in source_divergence._summed(sum_batches(rows, 7)):
        for r in b.to_pylist():
            assert r["level"] >= len(r["key"]) and (r["level"] == 4 or r["level"] < 2 * len(r["key"])) and (r["source"] is None) == r["open"]
            got_docs[r["lang"], r["key"], r["open"]] += r["docs"]
            if not r["open"]:
                got_times[r["lang"], r["source"], r["key"]] += r["times"]
    assert got_times == times and got_docs == docs


def test_a_task_hands_on_a_sum_once():
    """However many sources and languages its documents have: a row for each term of a source, documents of a language in one of them."""
    words = [f"{''.join(chr(97 + k // 26**j % 26) for j in range(4))}" for k in range(30_000)]
    rows = [(lang, source, " ".join(words).encode()) for _ in range(4) for lang in "xyz" for source in "abcd"]
    out = list(source_divergence._summed(sum_batches(rows, 12)))
    assert sum(b.num_rows for b in out) == 12 * 30_000
    held = [n for b in out for n in b.column("docs").to_pylist() if n]
    assert held == [16] * 3 * 30_000


def test_prefixes_are_refined(spark):
    """Long terms pass several levels; one that only shares its prefixes with others doesn't stay."""
    long = "a" * 70
    texts = [f"{long}x {long}y{i} b" for i in range(3)] + [f"{long}z", "abcdefgh1", "abcdefghi abcdefghi", None]
    docs = spark.createDataFrame([(t, "en", "s") for t in texts], "text string, lang string, source string")
    sums = docs.select("lang", "source", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(
        source_divergence._summed, "lang string, source string, level int, key binary, open boolean, docs long, times long")
    kept = {bytes(r.key).decode() for r in source_divergence.kept_terms(sums, 3).collect()}
    assert kept == {long + "x", long + "y", "b"}
    empty = docs.limit(0)
    assert source_divergence.divergence(empty).count() == 0


def brute_interactions(rows, labels):
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = defaultdict(lambda: [0] * 6)
    fails = []
    for i, text, _, source, *_ in rows:
        t = text or ""
        words = WORD.findall(t)
        f = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
             "E": i is not None and i > first[t]}
        fails.append((source or "", {k for k, v in f.items() if v}, labels.get(i, (0, 0))))
    for part in {x[0] for x in fails}:
        for order in itertools.permutations("ABCDE"):
            left = [x for x in fails if x[0] == part]
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                every = [x for x in fails if x[0] == part and f in x[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(every) - len(gone), sum(x[1] == {f} for x in every), sum(x[2][0] for x in gone), sum(x[2][1] for x in gone)]
    total = Counter()
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] += v[1]
    return {(*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_filter_interactions(spark, docs, monkeypatch, block_bytes):
    monkeypatch.setattr(filter_interactions, "BLOCK_BYTES", block_bytes)
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 90, 2)] + [(4, 1, 1), (None, 1, 1), (5000, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    known = defaultdict(lambda: (0, 0))
    for i, q, x in rows:
        if i is not None:
            known[i] = (max(known[i][0], int(q == 1)), max(known[i][1], int(x == 1)))
    got = [tuple(r) for r in filter_interactions.filter_interactions(docs, labels).collect()]
    want = brute_interactions(corpus(), known)
    assert len(got) == len(want) and set(got) == want
    assert filter_interactions.filter_interactions(docs.limit(0), labels).count() == 0


def test_matrix(docs, monkeypatch):
    monkeypatch.setattr(filter_interactions, "BLOCK_BYTES", 2000)
    import numpy as np

    shards = filter_interactions.csr_shards(docs).collect()
    texts = defaultdict(list)
    for i, text, *_ in corpus():
        texts[i].append(text or "")
    seen, numbers, times_of = Counter(), set(), Counter()
    for s in shards:
        starts, columns, times = np.frombuffer(s.starts, np.int64), np.frombuffer(s.columns, np.int64), np.frombuffer(s.times, np.int32)
        for k, d in enumerate(s.docs):
            seen[d.id] += 1
            own = times[starts[k] : starts[k + 1]]
            numbers |= set(columns[starts[k] : starts[k + 1]].tolist())
            times_of.update(dict(zip(columns[starts[k] : starts[k + 1]].tolist(), own.tolist())))
            assert sorted(own.tolist()) == sorted(Counter(WORD.findall(texts[d.id][0])).values())
    assert len(shards) > 5 and seen == Counter({i: len(t) for i, t in texts.items()})
    words = {w for ts in texts.values() for t in ts for w in WORD.findall(t)}
    assert len(numbers) == len(words)
    every = Counter(w for ts in texts.values() for t in ts for w in WORD.findall(t))
    assert sorted(times_of.values()) == sorted(every.values())  # a word has one number in all shards
