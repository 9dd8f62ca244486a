"""The corpus operators against brute force, on small tables that hold the awkward rows."""

import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import common, components, decontaminate, fingerprints, labelled, license_scan, mixing, near_dedup, pii, quality, queries, rolling, suffix_dedup, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shingle string, place long, u long, key long"
SF = "/root/testdata/sf0.01"


def prose(draw, n):
    return " ".join("".join(draw.choice("abcdeéñ") for _ in range(draw.randint(2, 6))) for _ in range(n))


def sample(seed=5):
    """Texts with copies, near copies, shared passages, nulls, empty texts and a long one."""
    draw = random.Random(seed)
    passage = prose(draw, 130)
    texts = [prose(draw, draw.randint(0, 120)) for _ in range(20)]
    long = prose(draw, 9000)
    base = prose(draw, 150).split(" ")
    near = []
    for k in range(12):
        own = list(base)
        own[k * 7] = "changed"
        near.append(" ".join(own))
    shared = [f"{prose(draw, 15)} {passage} {prose(draw, 12)}" for _ in range(6)]
    texts += [*near, *shared, long, long + " end", texts[3], texts[3].upper(), passage + passage, None, None, "", " \t\n ", "one two", "ONE two", "x" * 3000, "Ünder the MIT License", "under the mit license, Apache License, version 2.0; cc-by-nc"]
    texts += ["mail a.b@c.example.org or x@y, ip 10.0.0.1 999.1.1.1 card 4111 1111 1111 1111 tel +1 (555) 123-4567", 'token = "0123456789abcdef0123456789abcdef7"', "2" * 50, "+", "@", "a" * 500 + "@"]
    return texts


def table(spark, texts, ids=None):
    rows = [(i, t, "en", "s" if k % 3 else None, len(t or ""), "q", 1, 2, 3) for k, (i, t) in enumerate(zip(ids or range(1, len(texts) + 1), texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, sample()).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# 1

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(x):
    return (x or "").translate({c: c + 32 for c in range(65, 91)})


def test_contamination_equals_brute_force(spark, docs):
    texts = sample()
    base = texts[20].split(" ")
    items = [("a", " ".join(base[10:40])), ("b", "ONE two"), ("c", "never seen words here"), ("d", None), ("e", ""), (None, "one two"), ("f", " ".join(base[12:30])), ("a", "one two")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = by_id(decontaminate.contamination(docs, bench))
    for i, t in enumerate(texts, 1):
        words, hit, found = WORD.findall(ascii_lower(t)), set(), set()
        for name, text in items:
            own = WORD.findall(ascii_lower(text))
            if name is None or not own:
                continue
            n = min(10, len(own))
            for p in range(len(own) - n + 1):
                for q in range(len(words) - n + 1):
                    if words[q] == own[p] and words[q : q + n] == own[p : p + n]:
                        hit |= set(range(q, q + n))
                        found.add(name)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), len(found), bool(hit)), i
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    kept = decontaminate.without_hits(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.n_hit}


def test_contamination_of_empty_tables(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id string, text string")
    assert all(not r.contaminated for r in decontaminate.contamination(docs, none).collect())
    assert decontaminate.contamination(nothing, spark.createDataFrame([("a", "b c")], none.schema)).count() == 0


# 2


def test_fingerprints_of_neighbours(docs, nothing):
    texts = [x or "" for x in sample()]
    got = by_id(fingerprints.fingerprint_neighbours(docs))
    n = len(texts)
    for i in range(1, n + 1):
        text, after = texts[i - 1], texts[i - 2] if i > 1 else texts[n - 1]
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert [r.fingerprint, r.edited_fingerprint] == fingerprints.fingerprints([text.encode(), changed.encode()])
        assert r.near_next == fingerprints.likeness(r.fingerprint, fingerprints.fingerprints([after.encode()])[0]) and 0 <= r.near_edited <= 1
    assert fingerprints.fingerprint_neighbours(nothing).count() == 0


def brute_fingerprint(raw):
    """Chunk by chunk, in whole numbers."""

    def hashed(part):
        x = (sum(int(rolling.VALUES[c]) * pow(int(rolling.BASE), k, 1 << 64) for k, c in enumerate(part)) + len(part)) % (1 << 64)
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
        return x ^ x >> 31

    def signs(cuts):
        edges = sorted({0, len(raw), *cuts})
        return "".join(chr(fingerprints.LETTERS[hashed(raw[a:b]) >> 58]) for a, b in zip(edges, edges[1:], strict=False))

    if not raw:
        return "0::"
    zeros = []
    for i in range(len(raw)):
        bits = f"{hashed(raw[max(0, i - 6) : i + 1]):064b}"
        zeros.append(min(62, 64 - len(bits.rstrip("0"))))
    n = next(k for k in range(64) if sum(z >= k for z in zeros) < 64)
    return f"{n}:" + ":".join(signs([i + 1 for i, z in enumerate(zeros) if z >= k]) for k in (n, n + 1))


def test_fingerprints_equal_brute_force():
    draw = random.Random(12)
    texts = [x or "" for x in sample() if len(x or "") < 4000] + ["a" * 700, "é", "ab" * 300, prose(draw, 400)]
    raw = [x.encode() for x in texts]
    assert fingerprints.fingerprints(raw) == [brute_fingerprint(x) for x in raw]


def test_common_subsequence_equals_dynamic_programming():
    draw = random.Random(1)
    for _ in range(200):
        a, b = ("".join(draw.choice("abcd") for _ in range(draw.randint(0, 20))) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert fingerprints._common(a, b) == best[-1][-1]


# 3


def removed(texts, length):
    count = defaultdict(int)
    raw = [(x or "").encode() for x in texts]
    for x in raw:
        for p in range(len(x) - length + 1):
            count[x[p : p + length]] += 1
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for p in range(len(x) - length + 1):
            if count[x[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(x) else 0
        kept = bytes(b for b, g in zip(x, gone, strict=False) if not g)
        out.append((len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_equal_brute_force(docs, nothing):
    got = by_id(suffix_dedup.remove_repeats(docs))
    for i, want in enumerate(removed(sample(), 400), 1):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, i
    assert suffix_dedup.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("crowd", [1, 3])
def test_crowded_buckets_lose_no_repeat(spark, crowd):
    draw = random.Random(crowd)
    passage = prose(draw, 150)
    texts = [prose(draw, 5) + passage[draw.randint(0, 60) : len(passage) - draw.randint(0, 60)] + prose(draw, 5) for _ in range(12)]
    rows = table(spark, texts).select(F.col("doc_id").alias("uid"), "text")
    spans = defaultdict(list)
    for r in suffix_dedup.repeated_ranges(rows, crowd=crowd).collect():
        spans[r.uid].append((r.start, r.end))
    got = [sum(e - s for s, e in suffix_dedup.merged(*np.array(spans[i], np.int64).reshape(-1, 2).T)) for i in range(1, len(texts) + 1)]
    assert got == [w[1] for w in removed(texts, 400)] and any(got)


def test_repeated_and_null_ids_repeat_each_other(spark):
    text = prose(random.Random(2), 200)
    got = suffix_dedup.remove_repeats(table(spark, [text, text, "x"], [1, 1, None])).collect()
    assert sorted(r.n_removed for r in got) == [0, len(text.encode()), len(text.encode())]


def test_a_very_long_text_of_one_letter_is_one_range(spark):
    docs = table(spark, ["a" * 5_000_000, "b" * 399, "ab" * 300, None])
    began = time.monotonic()
    got = [(r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs).orderBy("doc_id").collect()]
    assert got == [(5_000_000, 5_000_000, 1), (399, 0, 0), (600, 600, 1), (0, 0, 0)]
    assert time.monotonic() - began < 60


def test_segments_of_a_long_text_lose_no_repeat(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    draw = random.Random(9)
    passage = prose(draw, 200)
    texts = [prose(draw, 900) + passage + prose(draw, 700), passage + prose(draw, 10), prose(draw, 800) + passage * 2]
    spans = defaultdict(list)
    rows = table(spark, texts).select(F.col("doc_id").alias("uid"), "text")
    for batch in [pa.RecordBatch.from_pylist([{"uid": r.uid, "text": r.text}]) for r in rows.collect()]:
        whole = suffix_dedup.runs_of(*rolling.buffers(batch.column("text")))
        starts = sorted(x for uid, base, data, offsets in suffix_dedup._segments(batch, 400) for a, b in zip(*[y + base[0] for y in suffix_dedup.runs_of(data, offsets)[1:3]], strict=True) for x in range(a, b + 1))
        assert starts == sorted(x for a, b in zip(whole[1], whole[2], strict=True) for x in range(a, b + 1))  # every suffix is in one run
    for r in suffix_dedup.repeated_ranges(rows).collect():
        spans[r.uid].append((r.start, r.end))
    got = [sum(e - s for s, e in suffix_dedup.merged(*np.array(spans[i], np.int64).reshape(-1, 2).T)) for i in (1, 2, 3)]
    assert got == [w[1] for w in removed(texts, 400)] and all(got)


# 4


def test_token_counts_equal_the_library(docs, nothing):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    got = by_id(token_counts.count_tokens(docs))
    for i, t in enumerate(sample(), 1):
        n = len(model.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096), i
    assert token_counts.count_tokens(nothing).count() == 0


def test_what_tasks_tell_is_bounded_and_holds_the_heaviest(spark):
    for tasks in (1, 32, 211, 5000, 1 << 17, 1 << 20):
        own, slices = token_counts.shares(tasks, 4096, 1 << 17)
        assert own * tasks <= max(1 << 17, tasks) and own * slices >= 4096
    draw = random.Random(4)
    words = [prose(draw, 1) for _ in range(60)]
    docs = table(spark, [" ".join(draw.choices(words, [1 / (k + 1) for k in range(60)], k=200)) for _ in range(300)]).repartition(24)
    every = token_counts.frequent_lengths(docs, "piece_bpe_32k.model", per_task=32)
    sliced = token_counts.frequent_lengths(docs, "piece_bpe_32k.model", per_task=32, told=24 * 8)  # 4 slices of 6 tasks
    assert all(every[w] == n for w, n in sliced.items() if w in every)
    assert 32 <= len(every) and 24 <= len(sliced) <= len(every) + 32 and " " + words[0] in sliced and " " + words[1] in sliced


# 5, 6


def held_out(spark, label, learn, score):
    """Accuracy and area under the curve over labelled rows that were not learnt."""
    import duckdb

    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    found = labelled.labelled_texts(docs, labels, label, queries.FIT_ROWS, learn)
    want = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{SF}/labels.parquet'").fetchall())
    rows = [(s, p, want[i]) for i, s, p, out in score(docs, found) if out and want.get(i) is not None]
    good, bad = ([s for s, _, w in rows if w == k] for k in (1, 0))
    area = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    return np.mean([p == w for _, p, w in rows]), area


def test_quality_on_held_out_rows(spark, nothing):
    def score(docs, found):
        return [(r.doc_id, r.score, r.predicted, r.held_out) for r in quality.score_quality(docs, quality.train(*found)).collect()]

    accuracy, area = held_out(spark, "quality", quality.learnable(), score)
    assert accuracy > 0.8 and area > 0.85, (accuracy, area)
    assert quality.score_quality(nothing, quality.train([], [])).count() == 0


def test_toxicity_on_held_out_rows(spark, nothing):
    def score(docs, found):
        chain = toxicity.train(*found)
        out = {r.doc_id for r in docs.filter(f"not ({quality.learnable()})").select("doc_id").collect()}
        return [(r.doc_id, r.toxic, int(r.rejected), r.doc_id in out) for r in toxicity.score_toxicity(docs, chain).collect()]

    accuracy, area = held_out(spark, "toxic", quality.learnable(), score)
    assert accuracy > 0.95 and area > 0.9, (accuracy, area)
    assert toxicity.score_toxicity(nothing, toxicity.train([], [])).count() == 0


def test_classifiers_score_awkward_rows(docs):
    model = quality.train(["good text here", "bad bad bad"], [1, 0])
    chain = toxicity.train(["nice words", "you idiot", "you idiot again"], [0, 1, 1])
    n = docs.count()
    scores = [r.score for r in quality.score_quality(docs, model).collect()]
    assert len(scores) == n and all(0 <= s <= 1 for s in scores)
    assert toxicity.score_toxicity(docs, chain).filter("toxic between 0 and 1").count() == n


# 7


def test_mixing_uses_every_document_and_meets_the_weights(spark, docs, nothing):
    got = mixing.mix_sources(docs, block_tokens=50).collect()
    assert {r.doc_id for r in got} == set(range(1, len(sample()) + 1))
    assert all(0 <= r.slot <= 1 for r in got)
    assert mixing.mix_sources(nothing).count() == 0


def brute_quotas(tokens, target, most):
    """The largest exponent on a fine grid that is flat enough, moved towards 1 until nothing repeats too often."""

    def fill(x):
        w = tokens**x / (tokens**x).sum()
        return w, w * (tokens / w).max()

    grid = np.linspace(1, 0, 20_001)
    flat = [x for x in grid if mixing.entropy(fill(x)[0]) >= target * np.log(len(tokens)) - 1e-9]
    start = flat[0] if flat else 0.0
    return next(fill(x)[1] for x in grid[::-1] if x >= start and (fill(x)[1] <= most * tokens * (1 + 1e-9)).all())


def test_mixing_equals_what_is_counted_again(spark):
    draw = random.Random(8)
    sizes = {"big": 300, "middle": 80, "small": 30, "idle": 4}
    rows = [(k, prose(draw, draw.randint(1, 30)) if s != "idle" else " ", s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, target=0.95, most=3.0, block_tokens=100).collect()
    words = {i: len(t.split()) for i, t, _ in rows}
    total = {s: sum(words[i] for i, _, x in rows if x == s) for s in sizes}
    names = ["big", "middle", "small"]
    quota = dict(zip(names, brute_quotas(np.array([float(total[s]) for s in names]), 0.95, 3.0), strict=True))
    for s in names:
        own = sorted((r for r in got if r.source == s), key=lambda r: (r.copy, r.slot))
        ids = {i for i, _, x in rows if x == s}
        q = quota[s]
        assert abs(sum(r.n_tokens for r in own) - q) <= 31 + 0.002 * q  # the last document would not fit
        upto = 0
        for r in own:  # slots tell the places in the quota, without gaps
            assert r.n_tokens == words[r.doc_id] and abs(r.slot * q - upto) <= 0.002 * q + 1
            upto += r.n_tokens
        last = max(r.copy for r in own)
        for copy in range(last + 1):
            passed = [r for r in own if r.copy == copy]
            assert len({r.doc_id for r in passed}) == len(passed) and (copy == last or {r.doc_id for r in passed} == ids)
            turns = [r.block for k, r in enumerate(passed) if not k or passed[k - 1].block != r.block]
            assert len(turns) == len(set(turns))  # a block's documents follow one another
        assert len({tuple(r.doc_id for r in own if r.copy == c) for c in range(last + 1)}) == last + 1
        where = {}
        assert all(where.setdefault(r.doc_id, r.block) == r.block for r in own)
    idle = [r for r in got if r.source == "idle"]
    assert len(idle) == 4 and all((r.copy, r.slot, r.n_tokens) == (0, None, 0) for r in idle)


def test_exponents_meet_entropy_and_repetition():
    tokens = np.array([1e6, 1e4, 100.0])
    exponent, full = mixing.exponent_for(tokens, 0.9, 1e9, 1e6)
    assert 0 < exponent < 1 and full == 1e6 and abs(mixing.entropy(mixing.weights_at(tokens, exponent)) - 0.9 * np.log(3)) < 1e-6
    exponent, full = mixing.exponent_for(tokens, 0.9, 4.0, None)
    quota = mixing.weights_at(tokens, exponent) * full
    assert (quota <= 4.001 * tokens).all() and (quota >= tokens * (1 - 1e-9)).all()


# 8


def groups(texts):
    space = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for t in texts:
        w = space.findall(ascii_lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def test_many_rows_of_one_id_are_neighbours_by_text(spark):
    draw = random.Random(4)
    texts = ["p" * draw.choice([0, 10, 70]) + prose(draw, draw.randint(1, 30)) for _ in range(120)] + ["same"] * 5
    ids = [draw.choice([None, None, 5, k]) for k in range(len(texts))]
    rows = sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    follow = [*rows[1:], rows[0]]
    want = sorted((str(i), hashlib.sha256(fingerprints.edited(a, b).encode()).hexdigest()) for (i, a), (_, b) in zip(rows, follow, strict=True))
    got = fingerprints.fingerprint_neighbours(table(spark, texts, ids).repartition(6)).collect()
    assert sorted((str(r.doc_id), r.edited_sha256) for r in got) == want


@pytest.mark.parametrize("seed", [5, 6])
def test_near_duplicates_equal_brute_force(spark, nothing, seed):
    texts = sample(seed)
    got = by_id(near_dedup.near_duplicates(table(spark, texts)))
    sizes, roots = groups(texts)
    for i in range(1, len(texts) + 1):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (sizes[i - 1], roots[i - 1] + 1, roots[i - 1] == i - 1), i
    assert near_dedup.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("chunk", [3, 800])
def test_families_of_near_copies_lose_no_link(spark, monkeypatch, chunk):
    """Copies of a text that is not there itself: few are linked with the smallest, many with one another."""
    monkeypatch.setattr(near_dedup, "CHUNK_ROWS", chunk)
    draw = random.Random(chunk)
    texts = []
    for _ in range(3):
        base = prose(draw, 200).split(" ")
        for _ in range(40):
            own = list(base)
            for k in draw.sample(range(200), draw.randint(1, 5)):
                own[k] = prose(draw, 1) + "x"
            texts.append(" ".join(own))
    draw.shuffle(texts)
    got = by_id(near_dedup.near_duplicates(table(spark, texts)))
    _, roots = groups(texts)
    assert [got[i + 1].component_id for i in range(len(texts))] == [r + 1 for r in roots]
    assert 1 < len(set(roots)) < len(texts)


def test_blocks_meet_once_and_leave_large_components_alone(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK_ROWS", 4)
    draw = random.Random(8)
    rows = [(k, 0 if k < 30 else k, draw.choice([1, 20, 22, 40, 46]), k % 3 // 2) for k in range(60)] + [(100 + k, 100, 9, 7) for k in range(6)] + [(200, 200, 9, 8), (201, 201, 9, 8)]
    sent = near_dedup.blocks(spark.createDataFrame(rows, "rep long, root long, n int, family long"), 85).collect()
    held: dict = {}
    for r in sent:
        held.setdefault((r.family, r.i, r.j), ([], []))[r.side].append(r.uid)
    met: dict = {}
    for (_, i, j), (mine, theirs) in held.items():
        assert len(mine) == len(set(mine)) and bool(theirs) == (i != j)
        for a, b in ((a, b) for a in mine for b in theirs or mine if theirs or a < b):
            met[frozenset((a, b))] = met.get(frozenset((a, b)), 0) + 1
    assert set(met.values()) == {1}
    told = {k: (root, n, family) for k, root, n, family in rows}
    for a, b in ((a, b) for a in told for b in told if a < b):
        (root, n, family), (other, m, f) = told[a], told[b]
        if family == f and root != other and 100 * min(n, m) >= 85 * max(n, m):
            assert frozenset((a, b)) in met
    assert not any(x < 30 for pair in met if all(x < 30 for x in pair) for x in pair) and not any(100 <= x < 200 for x in set().union(*met))


def test_joined_components_equal_all_pairs():
    draw = np.random.default_rng(2)
    sets = [np.sort(draw.choice(60, draw.integers(20, 40), replace=False)).astype(np.uint64) for _ in range(40)]
    sets += [np.union1d(x[2:], [np.uint64(99)]) for x in sets[:20]]
    rows = [(i, i, x) for i, x in enumerate(sets)]
    pairs = {(i, j) for i, _, x in rows for j, _, y in rows if i < j and near_dedup.linked(x, y, 85)}
    found = near_dedup.joining(rows, [], 85)
    assert pairs and {tuple(sorted(p)) for p in found} <= pairs
    ends = lambda links: {frozenset(g) for g in _merged(links)}
    assert ends(found) == ends(pairs)
    assert ends(near_dedup.joining(rows[:30], rows[30:], 85)) == ends({p for p in pairs if p[0] < 30 <= p[1]})


def _merged(links):
    out: list[set] = []
    for a, b in links:
        met = [g for g in out if a in g or b in g]
        out = [g for g in out if g not in met] + [{a, b}.union(*met)]
    return out


def test_rows_that_share_an_id_are_linked_by_their_texts_alone(spark):
    texts = ["a b c d e f", "g h i j k l", "a b c d e f", "g h i j k l", "", None, "z z", "z z"]
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table(spark, texts, [7, 7, 9, 8, 7, 7, None, None])).collect()]
    assert sorted(got, key=str) == sorted([(7, 2, 7, True), (7, 2, 7, True), (9, 2, 7, False), (8, 2, 7, False), (7, 0, 7, True), (7, 0, 7, True), (None, 1, None, True), (None, 1, None, True)], key=str)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 90)] + [(200, 150), (5, 5), (200, 150)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(91)} | {150: 150, 200: 150}


def test_one_row_of_each_group_stays(spark):
    texts = ["a b c d e f", "a b c d e f", "a b c d e f", "", None, "z"]
    left = near_dedup.without_copies(table(spark, texts, [7, 7, 9, 10, 11, None]))
    assert sorted(((r.doc_id or 0), r.text or "") for r in left.collect()) == [(0, "z"), (7, "a b c d e f"), (10, ""), (11, "")]


# 9


def test_license_places_equal_brute_force(docs, nothing):
    got = by_id(license_scan.scan_licenses(docs))
    for i, t in enumerate(sample(), 1):
        words = WORD.findall(ascii_lower(t))
        places = [(p, label) for phrase, label in license_scan.PHRASES.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        r, at = got[i], sorted(p for p, _ in places)
        labels = {x for _, x in places}
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), at[0] if at else None, at[-1] if at else None), i
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(filter(None, r.labels.split(",")))
    assert license_scan.scan_licenses(nothing).count() == 0


def brute_ends(tokens, words, starts):
    """Places behind the tokens of a template, from any of the places ``starts``."""
    now, k = set(starts), 0
    while k < len(tokens):
        t = tokens[k]
        if t == "[[":
            depth, j = 1, k
            while depth:
                j += 1
                depth += (tokens[j] == "[[") - (tokens[j] == "]]")
            now |= brute_ends(tokens[k + 1 : j], words, now)
            k = j
        elif t == "{{#}}":
            now = {i + 1 for i in now if i < len(words) and words[i].isdecimal()}
        elif t[:2] == "{{":
            now = {j for i in now for j in range(i, min(len(words), i + int(t[2:-2])) + 1)}
        else:
            now = {i + 1 for i in now if i < len(words) and words[i] == t}
        k += 1
    return now


def written(draw, tokens):
    """A text that the template's tokens take."""
    out, k = [], 0
    while k < len(tokens):
        t = tokens[k]
        if t == "[[":
            depth, j = 1, k
            while depth:
                j += 1
                depth += (tokens[j] == "[[") - (tokens[j] == "]]")
            out += written(draw, tokens[k + 1 : j]) if draw.random() < 0.5 else []
            k = j
        elif t == "{{#}}":
            out.append(str(draw.randint(1, 4)))
        elif t[:2] == "{{":
            out += [draw.choice(["ann", "lee", "2020"]) for _ in range(draw.randint(0, int(t[2:-2])))]
        else:
            out.append(t)
        k += 1
    return out


def test_labels_equal_brute_force(spark):
    draw = random.Random(3)
    cut = [(label, re.sub(r"(\[\[|\]\])", r" \1 ", t).split()) for label, t in license_scan.TEMPLATES]
    texts = []
    for _, tokens in cut:
        for change in (0, 0, 1, 1):
            words = [*prose(draw, 5).split(), *written(draw, tokens), *prose(draw, 5).split()]
            if change:  # a word is changed, left out or put in
                at = draw.randrange(len(words))
                words[at : at + draw.randint(0, 1)] = draw.choice([[], ["odd"], [words[at].upper()]])
            texts.append(draw.choice([" ", ", ", "\n"]).join(words))
    texts += [" ".join(draw.sample(texts, 3)) for _ in range(10)] + ["copyright " * 50 + "all rights reserved", None, ""]
    got = by_id(license_scan.scan_licenses(table(spark, texts)))
    for i, t in enumerate(texts, 1):
        words, runs, score = WORD.findall(ascii_lower(t)), [], 0.0
        for label, tokens in cut:
            longest, at = sum(x not in ("[[", "]]") and (x[:2] != "{{" or x == "{{#}}") for x in tokens), 0
            while at < len(words):
                end = max(brute_ends(tokens, words, {at}), default=at)
                if end > at:
                    runs.append((at, label, end))
                    score = max(score, min(1.0, (end - at) / longest))
                at = max(end, at + 1)
        base = {label for phrase, label in license_scan.PHRASES.items() if f" {phrase} " in f" {' '.join(words)} "}
        assert got[i].matches == ",".join(f"{label}:{a}:{b}" for a, label, b in sorted(runs)), (t, got[i].matches)
        assert got[i].labels == ",".join(sorted({label for _, label, _ in runs} | base)) and abs(got[i].score - score) < 1e-12
    assert all(got[1 + 4 * k].labels and got[2 + 4 * k].labels for k in range(len(cut)))


def test_automata_take_optional_and_replaceable_words():
    own = license_scan.Automaton("x", "copyright [[c]] {{2}} all rights")
    for text, end in (("copyright all rights", 3), ("copyright c jo doe all rights", 6), ("copyright c a b d all rights", 0), ("copyright all", 0)):
        assert own.match(text.split(), 0) == end, text


# 10


def test_base_spans_equal_the_patterns(docs, nothing):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def right(kind, x):
        digits = re.sub(r"[^0-9]", "", x)
        if kind == "ip":
            return all(int(p) <= 255 for p in x.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    got = by_id(pii.find_pii(docs))
    for i, t in enumerate(sample(), 1):
        spans = [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, t or "") if right(k, m[0])]
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in kinds], i
        assert r.base_sha256 == hashlib.sha256(pii.joined(spans).encode()).hexdigest()
        assert set(filter(None, pii.joined(spans).split(","))) <= set(r.spans.split(","))
    assert pii.find_pii(nothing).count() == 0


def test_viterbi_equals_all_paths():
    from itertools import product

    draw = np.random.default_rng(4)
    move = draw.normal(size=(3, 3))
    for n in (1, 2, 4):
        score = draw.normal(size=(n, 3))
        value = lambda p: move[0, p[0]] + move[p[-1], 0] + sum(score[k, x] for k, x in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert tuple(pii.viterbi([score], move)[0]) == max(product(range(3), repeat=n), key=value)


def test_redaction_keeps_nulls_and_counts(docs):
    got = by_id(pii.redact(docs))
    for i, t in enumerate(sample(), 1):
        assert (got[i].text is None) == (t is None) and got[i].n_chars == len(got[i].text or "")
    assert "<EMAIL>" in got[[k for k, t in enumerate(sample(), 1) if t and t.startswith("mail ")][0]].text


# all of them: clashing names, null ids, repeated rows, long texts, empty tables

CLASHES = ["id", "hits", "block", "copy", "slot", "n_tokens", "_n", "_gone", "_twice", "_row", "row", "uid", "key", "h", "s", "t", "q", "w", "c", "kept", "place"]


@pytest.fixture(scope="module")
def awkward(spark):
    draw = random.Random(12)
    twice = prose(draw, 60)
    texts = [twice, twice, twice, None, None, "", "", "you stupid " * 3, "you stupid " * 3, prose(draw, 150_000), prose(draw, 30)]
    ids = [4, 4, None, None, 5, None, 6, 7, 7, 8, 9]
    rows = [(i, t, "en", None if k % 2 else "s", 1, *CLASHES) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    names = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame(rows, names).repartition(3).cache()


def stage_results(df, nothing):
    """What each operator and stage makes of a table."""
    bench = df.sparkSession.createDataFrame([("a", "stupid you stupid")], "item_id string, text string")
    chain = toxicity.train(["nice words", "you stupid", "you stupid again", "more words"], [0, 1, 1, 0])
    model = quality.train(["good text here", "bad bad bad"], [1, 0])
    yield "1", decontaminate.contamination(df, bench), None
    yield "2", fingerprints.fingerprint_neighbours(df), None
    yield "3", suffix_dedup.remove_repeats(df), None
    yield "4", token_counts.count_tokens(df), None
    yield "5", toxicity.score_toxicity(df, chain), None
    yield "6", quality.score_quality(df, model), None
    yield "8", near_dedup.near_duplicates(df), None
    yield "9", license_scan.scan_licenses(df), None
    yield "10", pii.find_pii(df), None
    yield "mixed", mixing.mix_sources(df, budget=None), None
    yield "redacted", pii.redact(df), df.columns
    yield "clean", toxicity.keep_clean(df, chain), df.columns
    yield "unseen", decontaminate.without_hits(df, bench), df.columns
    yield "distinct", near_dedup.without_copies(df), df.columns


def test_awkward_rows_and_names(awkward, nothing):
    n, twos = awkward.count(), {"clean": 9, "unseen": 9, "distinct": 9}
    for name, found, columns in stage_results(awkward, nothing):
        rows = found.collect()
        assert columns is None or found.columns == columns, name
        if name == "mixed":
            assert found.columns[:26] == awkward.columns and found.columns[26:] == ["mixed_n_tokens", "mixed_copy", "mixed_block", "mixed_slot"]
            assert len({(r.doc_id, r.text, r.source) for r in rows}) == len({(r.doc_id, r.text, r.source) for r in awkward.collect()}) and len(rows) >= n
        else:
            assert len(rows) == twos.get(name, n), name
        if columns:
            assert all(r[c] == c for r in rows for c in CLASHES), name
        if name == "distinct":
            assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in rows if r.doc_id in (4, 7)) == [(4, next(r.text for r in rows if r.doc_id == 4)[:3]), (7, "you")]
        same = defaultdict(set)  # equal rows get equal results, whatever their number
        if not columns and name not in ("2", "mixed"):
            for r in rows:
                same[r.doc_id].add(tuple(r))
            assert len(same[7]) == len(same[4]) == 1, name


def test_empty_tables(awkward, nothing):
    for name, found, columns in stage_results(awkward.limit(0), nothing):
        assert found.count() == 0 and (columns is None or found.columns == columns), name


def test_fit_sample_is_fixed_and_whole(spark):
    docs = table(spark, ["a", "b " * 100_000, "c", "d", None], [1, 2, 2, 3, 4])
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (4, 1), (None, 1)], "doc_id long, toxic int")
    assert labelled.labelled_texts(docs, labels, "toxic", 10) == (["a", "b " * 100_000], [1, 1])
    assert labelled.labelled_texts(docs.repartition(4), labels, "toxic", 10) == labelled.labelled_texts(docs, labels, "toxic", 10)
    assert len(labelled.labelled_texts(docs, labels, "toxic", 1)[0]) <= 1


def test_secrets_of_letters_and_long_tokens():
    field = pii.train()
    draw = random.Random(3)
    letters = "".join(draw.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(32))
    hexed = "%040x" % random.Random(5).getrandbits(160)
    texts = [f'the config has secret = "{letters}" in it', f"password: {hexed} is old", "a Bundesverfassungsgericht is a court", "x" * 300_000 + " and 12 more", "=" * 60]
    _, every = pii.find_spans(texts, field)
    assert ("secret", texts[0].index(letters), texts[0].index(letters) + 32) in every[0]
    assert ("secret", texts[1].index(hexed), texts[1].index(hexed) + 40) in every[1]
    assert every[2:] == [[], [], []]


def test_the_field_finds_what_its_table_draws_anew():
    """Held-out draws of the labelled table: other values, other names, in the same and other orders."""
    field = pii.train()
    right = known = found = 0
    for tokens, labels in pii.labelled_table(copies=3, seed=99):
        places = [i for i, t in enumerate(tokens) if pii.can_be(t)]
        got = np.zeros(len(tokens), int)
        for a in (i for i in places if i - 1 not in places):
            b = next(j for j in range(a, len(tokens) + 1) if j not in places)
            got[a:b] = pii.viterbi(field.scores([tokens], [(a, b)]), field.move)[0]
        right += sum(g and g == w for g, w in zip(got, labels, strict=True))
        known, found = known + sum(map(bool, labels)), found + sum(map(bool, got))
    assert right / known > 0.93 and right / found > 0.93, (right, known, found)
