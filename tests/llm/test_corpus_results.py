"""Queries against brute force, round trips and held-out accuracy, on the smallest tables."""

import base64
import hashlib
import math
import os
import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq_file
import pytest
import tiktoken

import corpus_pipeline
from millrace.llm import arc, bpe, hmm, hostrules, mixing, ngram_join, pq, registry, suffix, surrogates
from millrace.llm.common import table
from millrace.llm.components import components, roots

FOLDER = "/root/testdata/sf0.001"


def rows_of(name):
    return pq_file.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r for r in rows_of("documents")}


@pytest.fixture(scope="module")
def vocabulary():
    ranks, pattern = bpe.production_ranks()
    v = bpe.Vocabulary(bpe.read_ranks(ranks), pattern)
    return v, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=v.ranks, special_tokens={})


def test_bpe_as_the_library(spark, docs, vocabulary):
    v, library = vocabulary
    got = {r["doc_id"]: r for r in bpe.op1_bpe(spark, FOLDER).collect()}
    assert got.keys() == docs.keys()
    for k, d in docs.items():
        ids = np.array(library.encode_ordinary(d["text"]), "<u4").tobytes()
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(d["text"].encode()).hexdigest())


def test_bpe_on_odd_strings(vocabulary):
    v, library = vocabulary
    rng = random.Random(5)
    signs = " \n\t\r\x1c\x85\xa0'aabsStTre09é中🙂.,!-_\0"
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 16)))
        assert np.frombuffer(v.encode(text), "<u4").tolist() == library.encode_ordinary(text), repr(text)
        assert v.decode(v.encode(text)) == text.encode()


def test_bpe_append_and_edit(vocabulary):
    v, _ = vocabulary
    rng = random.Random(3)
    data = "the quick brown fox çà et là tokenization of strings ".encode() * 6
    t = bpe.PrefixTable(v, data)
    assert t.tokens() == v.merged(data)
    for _ in range(12):
        a = rng.randrange(len(t.data))
        b = min(len(t.data), a + rng.randrange(6))
        before = t.computed
        t.edit(a, b, rng.choice([b"", b"x", b" the", b"ization"]))
        assert t.tokens() == bpe.PrefixTable(v, bytes(t.data)).tokens()
        assert t.computed - before <= 3 * t.span + 8
    t.append(b" more text")
    assert t.tokens() == v.merged(bytes(t.data))


def test_mixture_meets_targets(spark, docs):
    got = mixing.op2_mixing(spark, FOLDER).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.op2_mixing(spark, FOLDER).collect()))
    sums, aims = Counter(), {}
    for r in got:
        d = docs[r["doc_id"]]
        assert r["size"] == len(d["text"].encode().split()) and 0 <= r["taken"] <= 3 * r["size"]
        sums[d["source"]] += r["taken"]
        aims[d["source"]] = (r["source_size"], r["target"])
    sizes = Counter()
    for d in docs.values():
        sizes[d["source"]] += len(d["text"].split())
    names = sorted(sizes)
    want = mixing.targets([sizes[n] for n in names], [i % 3 + 1 for i in range(len(names))])
    for n, w in zip(names, want, strict=True):
        assert aims[n] == (sizes[n], w) and abs(sums[n] - w) <= 1


def test_draws_follow_the_hypergeometric_law():
    rng = np.random.default_rng(3)
    count = np.array([30, 5, 0, 65], np.int64)
    got = np.array([mixing.drawn(count, 40, rng) for _ in range(20_000)])
    assert (got.sum(1) == 40).all() and (got <= count).all() and (got >= 0).all()
    share = count / 100
    assert np.allclose(got.mean(0), 40 * share, atol=0.1) and np.allclose(got.var(0), 40 * share * (1 - share) * 60 / 99, rtol=0.06, atol=0.01)
    large = np.array([3 * 10**12, 10**12], np.int64)
    left = mixing.drawn(large, 2 * 10**12, rng)
    assert left.sum() == 2 * 10**12 and abs(left[0] - 1.5 * 10**12) < 6 * 10**6


def test_taken_words_by_brute_force(spark):
    rows = mixing.placed(table(spark, FOLDER, "documents").select("doc_id", "text", "source"))
    plan, found = mixing.plan_of(rows), rows.collect()
    want = {}
    for p in plan:
        mine = sorted((r for r in found if r["source"] == p["source"] and r["size"]), key=lambda r: r["first"])
        assert [r["first"] for r in mine] == np.r_[0, np.cumsum([r["size"] for r in mine])[:-1]].tolist()
        owner, times, left = np.repeat(np.arange(len(mine)), [r["size"] for r in mine]), np.zeros(p["size"], int), round(p["target"])
        turn = 0
        while left:
            for b in mixing.permuted(np.arange(p["blocks"]), p["blocks"], mixing._key(0, p["number"], turn)).tolist():
                n = min(left, mixing.BLOCK, p["size"] - b * mixing.BLOCK)
                times[b * mixing.BLOCK : b * mixing.BLOCK + n] += 1
                left -= n
            turn += 1
        want |= {r["doc_id"]: int(n) for r, n in zip(mine, np.bincount(owner, times, len(mine)), strict=True)}
    assert {r["doc_id"]: r["taken"] for r in mixing.op2_mixing(spark, FOLDER).collect()} == {r["doc_id"]: want.get(r["doc_id"], 0) for r in found}


def test_slots_are_never_broadcast(spark):
    rows = mixing.placed(table(spark, FOLDER, "documents").select("doc_id", "text", "source"))
    plan = mixing.mixture(rows, mixing.plan_of(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("strategy=merge") >= 0


def test_targets_are_capped():
    assert mixing.targets([10, 1, 100], [1, 10, 1]) == [30.0, 3.0, 78.0]
    assert sum(mixing.targets([5, 5], [0.1, 9])) == 10


def test_permutations_and_shards():
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 9).tolist()) == list(range(n))
    totals = np.array([700, 5, 1300], np.int64)
    assert all(mixing.index_of(int(v), 1000, 9) == i for i, v in enumerate(mixing.permuted(np.arange(1000), 1000, 9)))
    parts = [mixing.shard_draw(totals, 8, 256, s, 1) for s in range(8)]
    assert (sum(c for _, c in parts) == totals).all()
    assert all((parts[i][0] + parts[i][1] == parts[i + 1][0]).all() for i in range(7))


def test_language_model(spark, docs):
    got = {r["doc_id"]: r for r in hmm.scored(table(spark, FOLDER, "documents"), head_words=500).collect()}
    words = {k: [*d["text"].encode().lower().split(), None] for k, d in docs.items()}
    counts = Counter(w for k, ws in words.items() if zlib.crc32(str(k).encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for k, ws in words.items():
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert abs(got[k]["base_score"] - base) < 1e-6 * abs(base)
        assert (got[k]["n_tokens"], got[k]["n_known"], got[k]["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
    out = [r for r in got.values() if r["held_out"]]
    assert out and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_hmm_by_brute_force(spark, docs):
    """The same training on one machine, with emissions of every word in one matrix."""
    words = {k: [w.decode() for w in d["text"].encode().lower().split()] for k, d in docs.items()}
    train = [k for k in words if zlib.crc32(str(k).encode()) % 10]
    counts = Counter(w for k in train for w in words[k])
    order = sorted(counts, key=lambda w: (-counts[w], w))
    place = {w: i for i, w in enumerate(order)}
    head, n = 300, 302
    scale = sum(counts.values()) + len(train) + 0.1 * (len(counts) + 2)
    own = np.array([counts[w] for w in order], float)
    base = np.r_[own[:head] + 0.1, own[head:].sum() + 0.1 * (len(own) - head + 1), len(train) + 0.1] / scale
    texts = {k: np.array([*[min(place.get(w, head), head) for w in ws], head + 1], np.uint16) for k, ws in words.items()}
    model = hmm.Model.of(*hmm.assigned([texts[k] for k in train], n, 8), base)
    model = hmm.Model.of(*hmm.expected(model, [texts[k] for k in train], n), base)
    wide = hmm.Model(model.start, model.step, np.r_[model.emit, np.repeat(model.emit[head:n - 1], len(own), 0)])
    full = {k: np.array([*[place[w] if place[w] < head else n + place[w] for w in words[k]], head + 1]) for k in train}
    start, step, emitted = hmm.expected(wide, list(full.values()), n + len(own))
    shares = emitted[n + head :] / emitted[n + head :].sum(1, keepdims=True)
    for _ in range(2):  # as the operator keeps them: in a run of rows, and in the table
        shares = np.rint(255 * np.sqrt(shares)) ** 2
        shares /= shares.sum(1, keepdims=True)
    every = np.r_[emitted[:head], shares * own[head:, None], emitted[head + 1][None], np.zeros((1, 8))]  # words, end, unknown
    plain = np.r_[own + 0.1, len(train) + 0.1, 0.1] / scale
    best = hmm.Model.of(start, step, every, plain)
    assert np.allclose(best.emit.sum(0), 1)
    got = {r["doc_id"]: r for r in hmm.scored(table(spark, FOLDER, "documents"), rounds=((1, 2),), head_words=head).collect()}
    for k, ws in words.items():
        score = hmm.log_likelihood(best, [np.array([*[place.get(w, len(own) + 1) for w in ws], len(own)])])[0]
        assert abs(got[k]["score"] - score) < 1e-3 * abs(score)


def test_forward_is_exact():
    rng = np.random.default_rng(0)
    emit = rng.dirichlet(np.ones(6), 3).T
    model = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), emit)
    texts = [np.array(t, np.uint16) for t in ([0, 5], [1, 2, 3, 5], [5])]
    for t, got in zip(texts, hmm.log_likelihood(model, texts), strict=True):
        total = 0.0
        for path in np.ndindex(*(3,) * len(t)):
            p = model.start[path[0]] * emit[t[0], path[0]]
            for i in range(1, len(t)):
                p *= model.step[path[i - 1], path[i]] * emit[t[i], path[i]]
            total += p
        assert abs(got - math.log10(total)) < 1e-9
    start, step, emitted = hmm.expected(model, texts, 6)
    assert abs(start.sum() - 3) < 1e-9 and abs(step.sum() - 4) < 1e-9 and abs(emitted.sum() - 7) < 1e-9


def test_surrogates(spark, docs):
    made = surrogates.with_surrogates(table(spark, FOLDER, "documents")).collect()
    becomes = {}
    for r in made:
        for a, b in zip(r["entities"], r["surrogates"], strict=True):
            assert a not in r["text"] and becomes.setdefault(a.lower(), b.lower()) == b.lower()
        if not r["entities"]:
            assert r["text"] == docs[r["doc_id"]]["text"]
    assert becomes and len(set(becomes.values())) == len(becomes)


def test_surrogates_keep_form(spark):
    text = "Mrs. Maria Lopez, Mr John Smith; a.b9@mail.example.com, A.B9@mail.example.com, 4111 1111 1111 1111, 78.118.65.158. +1 (304) 555-3522, password=45bb0d53635bf1b89d"
    row = surrogates.with_surrogates(spark.createDataFrame([(1, text), (2, "Maria went to Rome in 1999.")], "doc_id long, text string")).collect()
    first = min(row, key=lambda r: r["doc_id"])
    a = dict(zip(first["entities"], first["surrogates"], strict=True))
    assert a["Mrs. Maria Lopez"].split()[1] in surrogates.FEMALE.split() and a["Mr John Smith"].split()[1] in surrogates.MALE.split()
    assert a["a.b9@mail.example.com"].lower() == a["A.B9@mail.example.com"].lower()
    card = [int(c) for c in a["4111 1111 1111 1111"] if c != " "]
    assert sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(card)) % 10 == 0
    assert all(0 <= int(x) < 256 for x in a["78.118.65.158"].split("."))
    assert all(len(a[x]) == len(x) for x in a if not x.startswith(("Mr", "78.")))
    assert max(row, key=lambda r: r["doc_id"])["n_entities"] == 0


def test_spellings_of_one_number_stay_one(spark):
    texts = ["call 555-123-4567 or (555) 123-4567 or 555.123.4567 now", "GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00", "GB00WEST12345698765432", "4111 1111 1111 1111 and 4111-1111-1111-1111"]
    made = {r["doc_id"]: r["surrogates"] for r in surrogates.with_surrogates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    plain = {k: ["".join(c for c in x if c.isalnum()) for x in v] for k, v in made.items()}
    assert len(plain[0]) == 3 and len(set(plain[0])) == 1 and plain[0][0] != "5551234567"
    assert len(plain[1]) == 2 and len(set(plain[1])) == 1 and len(set(plain[4])) == 1
    true = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    assert true(plain[1][0]) and true(plain[2][0]) and not true(plain[3][0]) and plain[3][0][4:] == plain[1][0][4:]
    assert plain[1][0][:2] == "GB" and plain[2][0][:2] == "DE" and plain[1][0] != "GB82WEST12345698765432"


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    rows = [(i, (base[i % 60] + rng.normal(size=16) * 0.12 * (i // 60)).tolist()) for i in range(240)]
    got = {r["vec_id"]: tuple(r)[1:] for r in pq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    m = np.array([r[1] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    nodes, root = roots(a, b)
    of = dict(zip(nodes.tolist(), root.tolist(), strict=True))
    want = {i: (int(near[i].sum()), of.get(i, i), of.get(i, i) == i) for i in range(240)}
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert there > 100 and found >= 0.9 * there and all(got[i][0] <= want[i][0] for i in want)


def test_archives(spark):
    pages = rows_of("pages")
    by = defaultdict(list)
    for p in pages:
        by[(p["html"] or "").encode()].append(p["page_id"])
    want = {i: (len(k), base64.b32encode(hashlib.sha1(k).digest()).decode(), "response" if i == max(v) else "revisit", None if i == max(v) else max(v)) for k, v in by.items() for i in v}
    assert {r["page_id"]: tuple(r)[1:] for r in arc.op7_arc(spark, FOLDER).collect()} == want


def test_archive_versions_are_checked():
    good = arc.arc_opening(b"1", "19960101000000") + arc.legacy(1, "http://a", "x", b"1", "19960101000000")
    assert [r.fields["url"] for r in arc.read_arc(good)] == ["http://a"]
    with pytest.raises(ValueError):
        list(arc.read_arc(arc.arc_opening(b"2", "19960101000000") + arc.legacy(1, "http://a", "x", b"1", "19960101000000")))
    with pytest.raises(ValueError):
        list(arc.read_arc(good[:-3]))


def test_host_rules_as_sql(spark):
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    df = hostrules.op8_hostrules(spark, FOLDER)
    relation = connection.sql(registry.oracle_sql()["op8_hostrules"])
    places = [relation.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in places) for r in relation.fetchall())


def test_bad_hosts_are_rejected(spark):
    rows = [(i, "too short", "bad") for i in range(30)] + [(100 + i, f"this text of host bad is long enough to pass number {i}", "bad") for i in range(3)]
    rows += [(200 + i, f"this text of host good is long enough to pass number {i}", "good") for i in range(30)] + [(300, "short", "new"), (301, "one that is long enough to pass the rules by itself", "new")]
    kept = {r["doc_id"] for r in hostrules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("kept").collect()}
    assert kept == {*range(200, 230), 301}


def jaccard_groups(texts, size, percent):
    sets, up = {}, {k: k for k in texts}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(sets, key=lambda k: len(sets[k]))
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if len(sets[a]) * 100 < percent * len(sets[b]):
                break
            n = len(sets[a] & sets[b])
            if sets[a] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), top(k)) for k in sets}


def test_ngram_join_against_all_pairs(spark, docs):
    want = jaccard_groups({k: d["text"] for k, d in docs.items()}, 4, 85)
    assert {r["doc_id"]: tuple(r)[1:] for r in ngram_join.op9_ngram_join(spark, FOLDER).collect()} == want


def test_ngram_join_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 12)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for k in range(90):
        words = base[:]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        texts[k] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in ngram_join.groups(df).collect()} == jaccard_groups(texts, 4, 85)


def test_bitmaps_bound_from_above():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 5000, n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for n in (5, 100, 130, 700, 900)]
    bits = ngram_join.Bitmaps(map(ngram_join.bitmap, sets))
    for i in range(5):
        for j in range(5):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert (len(sets[i]) + len(sets[j]) - bits.differ(np.array([i]), np.array([j]))[0]) // 2 >= both


def brute_removed(texts, length=100):
    seen, out = set(), {}
    for k in sorted(texts):
        b, runs = texts[k].encode(), []
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
            seen.add(w)
        edges = [0, *(x for r in runs for x in r), len(b)]
        kept = b"".join(b[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
        out[k] = (len(b), len(b) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("change", [None, ("BITS", 64), ("HOT", 2)])
def test_repeats_against_all_strings(spark, docs, monkeypatch, change):
    if change:  # the join in place of the bitmap; anchors split from three contexts on
        monkeypatch.setattr(suffix, *change)
    want = brute_removed({k: d["text"] for k, d in docs.items()})
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix.op10_suffix(spark, FOLDER).collect()} == want


@pytest.mark.parametrize("hot", [2, 2000])
def test_periodic_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    texts = {1: "ab" * 300, 2: "x" * 250, 3: "b" + "ab" * 120, 4: "x" * 99, 5: "the same line again and again\n" * 20}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.removed(df).collect()} == brute_removed(texts)


def test_arrays_of_an_anchor_are_merged(monkeypatch):
    rng = random.Random(4)
    core = bytes(rng.randrange(97, 123) for _ in range(140))
    contexts = [bytes(rng.randrange(97, 123) for _ in range(rng.randrange(30))) + core + bytes(rng.randrange(97, 123) for _ in range(rng.randrange(30))) for _ in range(40)]
    owner = np.array([(rng.randrange(100), 0, 0) for _ in contexts]).T
    marked = lambda: sorted(zip(*(x.tolist() for x in suffix.later(contexts, owner)), strict=True))
    whole = marked()
    monkeypatch.setattr(suffix, "SHARD", 700)
    assert marked() == whole and len(whole) >= 39 * 41


def test_an_anchor_of_many_contexts_is_split(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 20)
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, texts = some(90), {}
    for k in range(150):  # equal contexts, nearly equal ones, and ones that share the line only
        texts[k] = some(rng.randrange(80)) + rng.choice(["xxxxxx", "yyyyyyy", some(6)]) + line + rng.choice(["zzzzzzzz", some(9)]) + some(rng.randrange(80))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.removed(df).collect()} == brute_removed(texts)


def test_a_split_makes_few_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 20)
    rng = random.Random(7)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = some(24)
    contexts = [(some(76) + line + some(76)).encode() for _ in range(300)]
    rows = spark.createDataFrame([(1, k, k, 0, 76, bytearray(c)) for k, c in enumerate(contexts)], suffix.MARKED)
    counts = spark.createDataFrame([(1, 300)], "h long, times long")
    made = suffix._split(rows, counts, suffix.FINER[0])[0].collect()
    # Each string of each context once, and the contexts cut into a few parts, not one for each place of the anchor.
    assert sorted((r["doc_id"], p) for r in made for p in range(r["first"], r["last"] + 1)) == [(k, p) for k in range(300) for p in range(77)]
    assert all(r["context"] == contexts[r["doc_id"]][r["first"] : r["last"] + 100] for r in made)
    assert len(made) < 6 * 300


def test_long_texts_come_in_pieces(spark, monkeypatch):
    text = "".join(random.Random(8).choice("abc ") for _ in range(3000))
    texts = {1: text[:2500], 2: "new" + text[700:1900] + "end", 3: text[2400:] + text[:300]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = lambda: [list(suffix._chunks([pa.RecordBatch.from_pylist([{"d": k, "k": k, "t": t}])])) for k, t in texts.items()]
    monkeypatch.setattr(suffix, "CHUNK", 300)
    assert all(sum(len(c[2]) for c in r) == -(-(len(t) - 99) // 300) for r, t in zip(rows(), texts.values(), strict=True))
    strings = [t[s + i : s + i + 100] for r in rows()[:1] for c in r for t, s in [(c[2][0].decode(), 0)] for i in range(len(t) - 99)]
    assert strings == [text[i : i + 100] for i in range(2401)]
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.removed(df).collect()} == brute_removed(texts)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 400):
        s = rng.integers(1, 4, n)
        order, rank = suffix.suffix_array(s)
        assert order.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
        assert (rank[order] == np.arange(n)).all()


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in registry.queries()["op6_toxicity"](spark, folder).collect()}
    labels = pq_file.read_table(f"{folder}/labels.parquet").to_pylist()
    out = [(r["toxic"], got[r["doc_id"]]["predicted"]) for r in labels if got[r["doc_id"]]["held_out"]]
    assert sum(t == p for t, p in out) >= 0.9 * len(out) and not any(p and not t for t, p in out)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(2000, 2300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes, root = roots(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    assert {k: v for k, v in got.items()} == {int(n): int(r) for n, r in zip(nodes, root, strict=True) if n in got}
    assert all(n in got or n == r for n, r in zip(nodes, root, strict=True))


def test_pipeline(spark, docs):
    stages = corpus_pipeline.STAGES
    out = stages[0][1](spark, table(spark, FOLDER, "documents"), FOLDER)
    ids = {r["doc_id"] for r in out.collect()}
    assert ids == {r["doc_id"] for r in hostrules.op8_hostrules(spark, FOLDER).filter("kept").collect()}
    out = stages[1][1](spark, out, FOLDER)
    left = {r["doc_id"] for r in out.select("doc_id").collect()}
    groups = jaccard_groups({k: docs[k]["text"] for k in ids}, 5, 80)
    assert left == {k for k, v in groups.items() if v[1] == k}
    mixed = stages[3][1](spark, out, FOLDER).collect()
    rows = mixing.placed(out)
    plan = mixing.plan_of(rows)
    of = {(p["number"], r["first"]): r["doc_id"] for r in rows.filter("size > 0").collect() for p in plan if p["source"] == r["source"]}
    taken = Counter()
    for r in mixing.mixture(rows, plan).collect():
        taken[of[r["number"], r["first"]]] += r["n_words"]
    words = Counter()
    for r in mixed:
        words[r["doc_id"]] += len(r["text"].split())
        assert " ".join(r["text"].split()[:3]) in " ".join(docs[r["doc_id"]]["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert words == taken and all(n <= 3 * len(docs[k]["text"].split()) for k, n in words.items())


def test_mined_words_do_not_depend_on_the_process():
    code = (
        "from millrace.llm import toxicity; import random; r = random.Random(1)\n"
        "t = [' '.join(r.choice('abcdefgh') + r.choice('xyz') * 3 for _ in range(30)) + (' insult ' if i % 3 else ' kind ') for i in range(200)]\n"
        "print(toxicity.mined(t + t[:50], [i % 3 > 0 for i in range(200)] + [i % 3 > 0 for i in range(50)]))"
    )
    said = {subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONHASHSEED": str(k), "PYTHONPATH": str(Path(corpus_pipeline.__file__).parent)}, capture_output=True, text=True, check=True).stdout for k in (1, 2, 3)}
    assert len(said) == 1 and "insu*" in said.pop()
