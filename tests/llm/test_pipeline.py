"""The pipeline's stages against what brute force says of their inputs."""

import re

import numpy as np

import corpus_pipeline
from weftline.llm import common, mixing, pii, queries, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(x):
    return (x or "").translate({c: c + 32 for c in range(65, 91)})


def test_stages_keep_columns_and_do_their_work(spark):
    docs = common.table(spark, SF, "documents")
    columns, seen, tables = docs.columns, {}, {}
    first = docs
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.staged(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns[: len(columns)] == columns
        assert docs.columns == columns or name == "mixing"
        assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty()
        seen[name], tables[name] = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}, docs
    # toxicity: exactly the documents that the operator rejects go, and what the labels call toxic with them
    rejected = {r.doc_id for r in toxicity.score_toxicity(first, queries.toxicity_chain(spark, SF)).collect() if r.rejected}
    every = {r.doc_id for r in first.select("doc_id").collect()}
    assert set(seen["toxicity"]) == every - rejected
    flags = {r.doc_id: r.toxic for r in common.table(spark, SF, "labels").collect()}
    toxic, clean = ({i for i, x in flags.items() if x == k and i in every} for k in (1, 0))
    assert len(rejected & toxic) >= 0.8 * len(toxic) and len(rejected & clean) <= 0.02 * len(clean)
    space = re.compile(r"[^\x20\x09-\x0D]+")
    # decontamination: of its input exactly the documents with a window go
    windows = set()
    for r in common.table(spark, SF, "benchmark").collect():
        w = WORD.findall(lower(r.text))
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        w = WORD.findall(lower(text))
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    assert set(seen["decontamination"]) == {i for i, t in seen["near_dedup"].items() if not hit(t)}
    # PII: the spans that the operator finds are replaced, the rest of a text stays, lengths are counted anew
    spans = {r.doc_id: r.spans for r in pii.find_pii(tables["decontamination"]).collect()}
    assert set(seen["pii"]) == set(seen["decontamination"])
    for i, text in seen["decontamination"].items():
        kinds: dict[int, str] = {}
        found = sorted((int(a), -int(b), kind) for kind, a, b in (x.split(":") for x in spans[i].split(",") if x))
        covered, upto = set(), -1
        for a, b, kind in found:
            if a > upto - 1:  # one that begins within an earlier one is part of it
                kinds[a] = f"<{kind.upper()}>"
            covered |= set(range(a, -b))
            upto = max(upto, -b)
        want = None if text is None else "".join(kinds.get(k, "" if k in covered else c) for k, c in enumerate(text))
        assert seen["pii"][i] == want, i
    assert all(r.n_chars == len(r.text or "") for r in tables["pii"].select("n_chars", "text").collect())
    # mixing: words are those of the texts, each source has its share of the tokens, copies of a source are all or the last
    words = {i: len(space.findall(t or "")) for i, t in seen["pii"].items()}
    source = {r.doc_id: r.source or "" for r in tables["pii"].select("doc_id", "source").collect()}
    rows = tables["mixing"].collect()
    total, used = {}, {}
    for i, s in source.items():
        total[s] = total.get(s, 0) + words[i]
    for r in rows:
        assert r.n_tokens == words[r.doc_id] and (r.source or "") == source[r.doc_id]
        used[source[r.doc_id]] = used.get(source[r.doc_id], 0) + words[r.doc_id]
    names = sorted(s for s, n in total.items() if n)
    weights = np.array([used[s] for s in names]) / sum(used.values())
    assert mixing.entropy(weights) >= 0.9 * np.log(len(names)) - 0.02 or max(used[s] / total[s] for s in names) > 3.9
    assert all(total[s] * 0.95 <= used[s] <= 4.05 * total[s] for s in names)
    # near-duplicates: no two that stay are linked
    sets = []
    for t in seen["near_dedup"].values():
        w = space.findall(lower(t))
        if w:
            sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    for i, a in enumerate(sets):
        assert not any(100 * len(a & b) >= 85 * len(a | b) for b in sets[:i])
    assert set(seen["mixing"]) == set(seen["pii"])
