"""The classifier and the pipeline as a whole, held against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import WORD, brute_fingerprint, brute_passages

import corpus_pipeline
from tendrel.llm import packing, quality_classifier
from tendrel.llm.common import mixed
from tendrel.llm.quality_classifier import CLEAN, DIMS, JUNK, NONE

BYTES = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_signals(text):
    raw = (text or "").encode()
    w = BYTES.findall(raw)
    n, letters = max(len(w), 1), re.findall(rb"[A-Za-z]", raw)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    times = Counter(grams)
    return {
        "n_words": len(w), "symbols": len(re.findall(rb"[#*$%&|<>]", raw)) / n, "upper": len(re.findall(rb"[A-Z]", raw)) / max(len(letters), 1), "bang": raw.count(b"!") / n, "bar": raw.count(b"|") / n,
        "repeat": sum(times[g] > 1 for g in grams) / max(len(grams), 1), "same": sum(a == b for a, b in zip(w, w[1:])) / n,
    }


def plain_votes(x):
    if not x["n_words"]:
        return [NONE] * 7
    junk = (x["symbols"] > 0.1, x["upper"] > 0.4, x["bang"] > 0.15, x["bar"] > 0.1, x["repeat"] > 0.35 and x["n_words"] >= 60, x["same"] > 0.1 and x["n_words"] >= 10)
    prose = x["symbols"] < 0.02 and x["bang"] < 0.05 and x["upper"] < 0.2 and x["same"] < 0.05 and (x["repeat"] < 0.2 or x["n_words"] < 60)
    return [JUNK if j else NONE for j in junk] + [CLEAN if prose else NONE]


def plain_posterior(votes, prior, rates):
    clean, junk = math.log(prior), math.log(1 - prior)
    for k, v in enumerate(votes):
        clean += math.log(rates[1][k][v])
        junk += math.log(rates[0][k][v])
    return 1 / (1 + math.exp(min(max(junk - clean, -500), 500)))


def plain_em(votes, rounds=200):
    """Over single documents, not over counts of patterns."""
    post, prior = [0.1 if JUNK in v else 0.9 for v in votes], 0.5
    for _ in range(rounds):
        new_prior = (sum(post) + 0.5) / (len(votes) + 1)
        rates = []
        for c in (0, 1):
            weight = [p if c else 1 - p for p in post]
            rows = [[sum(w for w, v in zip(weight, votes) if v[k] == x) + 0.5 for x in range(3)] for k in range(7)]
            rates.append([[x / sum(row) for x in row] for row in rows])
        new = [plain_posterior(v, new_prior, rates) for v in votes]
        done = abs(new_prior - prior) < 1e-9 and max(abs(a - b) for a, b in zip(new, post)) < 1e-7
        prior, post = new_prior, new
        if done:
            break
    return post


def plain_features(text):
    raw = (text or "").encode()
    kind = lambda b: b if b < 128 and not chr(b).isalnum() else ord("0") if 48 <= b <= 57 else ord("A") if 65 <= b <= 90 else ord("a")
    kinds = [32 if b in (9, 11, 12, 13) else kind(b) for b in raw]
    times = Counter()
    for k in range(len(kinds) - 3):
        a, b, c, d = kinds[k : k + 4]
        times[int(mixed(np.array([((a * 131 + b) * 131 + c) * 131 + d], np.uint64))[0]) % (DIMS - 64) + 64] += 1
    norm = math.sqrt(sum(times.values())) or 1
    out = defaultdict(float, {d: math.sqrt(n) / norm for d, n in times.items()})
    x = plain_signals(text)
    for j, name in enumerate(("repeat", "same", "symbols")):
        out[8 * j + min(int(x[name] * 8), 7)] += 0.5
    return out


def plain_scores(texts):
    votes = [plain_votes(plain_signals(t)) for t in texts]
    clean, rows = plain_em(votes), [plain_features(t) for t in texts]
    sums = sum(clean), len(clean) - sum(clean)
    w, bias, seen, seen_bias = defaultdict(float), 0.0, defaultdict(lambda: 1e-8), 1e-8
    score = lambda row: 1 / (1 + math.exp(-min(max(sum(w[d] * x for d, x in row.items()) + bias, -30), 30)))
    for _ in range(150):
        slope, slope_bias = defaultdict(float), 0.0
        for c, row in zip(clean, rows):
            off = (score(row) - c) * (c / max(sums[0], 1e-9) + (1 - c) / max(sums[1], 1e-9))
            slope_bias += off
            for d, x in row.items():
                slope[d] += off * x
        for d in slope:
            g = slope[d] + 1e-4 * w[d]
            seen[d] += g * g
            w[d] -= 0.5 * g / math.sqrt(seen[d])
        seen_bias += slope_bias**2
        bias -= 0.5 * slope_bias / math.sqrt(seen_bias)
    return [score(row) for row in rows]


def _texts():
    draw = random.Random(5)
    words = ["river", "Stone", "über", "2019", "end."] + ["".join(draw.choice("aeioulnrst") for _ in range(draw.randint(2, 8))) for _ in range(300)]
    prose = [" ".join(draw.choice(words) for _ in range(draw.randint(8, 90))) for _ in range(30)]
    junk = ["BUY NOW!!! " * 9, "a|b|c | d | e # $ %" * 4, "again again again " * 25, "CHEAP " * 30, "<x> & <y> * " * 8, "win! win! win! free!"]
    return [*prose, *junk, *junk, None, "", " \n\t", "again", "again", "end. end. no"]


@pytest.mark.parametrize("parts", [1, 5])
def test_classifier_against_plain_python(spark, parts):
    """One document a row in plain Python, however rows are dealt to tasks: what stands before a text in its batch says nothing about it."""
    texts = _texts()
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    out = {r.doc_id: (r._quality, r._n_words, r._kept) for r in quality_classifier.classify(table).collect()}
    for i, (text, score) in enumerate(zip(texts, plain_scores(texts))):
        n = len(BYTES.findall((text or "").encode()))
        assert out[i][0] == pytest.approx(score, abs=1e-4) and out[i][1] == n, (i, text)
        if abs(score - 0.3) > 1e-3:
            assert out[i][2] == (score >= 0.3 and n > 0)
    kept = [out[i][2] for i in range(len(texts))]
    assert sum(kept[:30]) >= 28 and not any(kept[30:42])


def test_stages_against_plain_python(spark, sf_dir):
    """The stages of the pipeline, each on what the one before keeps, with null, empty and repeated rows, ids without a row of their own, and columns named as those that operators add."""
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near_dedup", "passages", "packed"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = docs.agg(F.max("doc_id")).first()[0]
    own = " ".join(f"own{k}" for k in range(80))
    odd = [(top + 1, None), (top + 2, ""), (top + 3, own), (top + 3, own), (top + 4, "one short text of its own here"), (top + 4, "quite another one with that id too"), (None, " ".join(f"w{k}" for k in range(70)))]
    odd += [(top + 5, " ".join([*own.split()[:-1], "changed"])), (top + 6, " ".join(f"own{k}" for k in range(60)) + " " + " ".join(f"later{k}" for k in range(90)))]
    table = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    for c in ("_node", "_kept", "_quality", "_n_words", "_n_lines", "_n_removed", "start", "sequence_id", "a", "component"):
        table = table.withColumn(c, F.lit(7))
    passed = stages["quality"](spark, table, sf_dir)
    assert passed.columns == table.columns and passed.where("text IS NULL OR trim(text) = ''").isEmpty() and 0 < passed.count() < table.count()

    lined = stages["lines"](spark, table, sf_dir)
    assert lined.columns == table.columns
    before, ids = [(r.doc_id, r.text) for r in table.collect()], defaultdict(set)
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))
    for i, text in before:
        for line in (text or "").split("\n"):
            ids[key(line)] |= {i} - {None}
    common = {k for k, of in ids.items() if k and len(of) >= 10}
    want = [(i, "\n".join(x for x in (text or "").split("\n") if key(x) not in common)) for i, text in before]
    rows = [(r.doc_id, r.text) for r in lined.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str) and common

    near = stages["near_dedup"](spark, lined, sf_dir)
    points, sets = [brute_fingerprint(t) for _, t in rows], []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    name = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (points[a] ^ points[b]).bit_count() <= 4 or (sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = sorted((name[a], name[b]))
                name = [x if n == y else n for n in name]
    groups = defaultdict(list)
    for at, (i, t) in enumerate(rows):
        groups[name[at]].append((i is None, math.inf if i is None else i, t))
    left = [(None if none else i, t) for none, i, t in map(min, groups.values())]
    found = [(r.doc_id, r.text) for r in near.collect()]
    assert near.columns == table.columns and len(found) < len(rows) - 2
    assert (Counter(left) - Counter(found), Counter(found) - Counter(left)) == (Counter(), Counter())
    assert (top + 5) not in {i for i, _ in found}  # one word of eighty differs

    cut = stages["passages"](spark, near, sf_dir)
    single = {i for i, n in Counter(i for i, _ in found).items() if n == 1 and i is not None}
    words = brute_passages([(i, t) for i, t in found if i in single], 50)
    after = [(r.doc_id, WORD.findall(r.text or "")) for r in cut.collect()]
    assert cut.columns == table.columns and {i: w for i, w in after if i in single} == words and len(words[top + 6]) == 90
    assert Counter(i for i, _ in after) == Counter(i for i, _ in found)

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    sizes = Counter((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in cut.collect())
    pieces = stages["packed"](spark, cut, sf_dir).collect()
    whole, windows = Counter(), defaultdict(list)
    for r in pieces:
        windows[r.sequence_id].append((r.offset, r.length))
        if r.start == 0:
            whole[r.doc_id, r.doc_tokens] += 1
    assert whole == sizes and sum(r.length for r in pieces) == sum(n * k for (_, n), k in sizes.items())
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert stages["near_dedup"](spark, lined.limit(0), sf_dir).isEmpty() and stages["packed"](spark, cut.limit(0), sf_dir).isEmpty()
