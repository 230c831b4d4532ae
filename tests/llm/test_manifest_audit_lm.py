"""Merkle manifest, filter audit and LM scoring against brute-force versions on
small tables with nulls, ties, repeated rows and clashing columns."""
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourcinglens.llm import maxent
from sourcinglens.llm.filter_audit import filter_audit
from sourcinglens.llm.lm_scoring import score
from sourcinglens.llm.merkle import grown, manifest, version

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TREE string, pos long, n long, digest string, mask int, part string, `Text` string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def rows():
    rng = random.Random(3)
    words = ["the", "Of", "ALPHA", "alpha", "bêta", "x#y", "日本", "don't", "end."]
    out = [(1, "Same Text", "en", "a", 9), (1, "Same Text", "en", "a", 9), (None, "Same Text", "en", "a", 9), (None, None, None, None, None),
           (3, "", "en", "", 0), (4, None, "de", "lone", None), (5, " \n ", None, "a", 3), (6, "Same Text", "fr", "b", 9),
           (7, " ".join(rng.choice(words) + str(rng.randrange(400)) for _ in range(40_000)), "en", "b", None)]
    out += [(i, " ".join(rng.choice(words) + str(rng.randrange(9) if i % 3 else "") for _ in range(rng.choice([0, 5, 210, 260]))),
             "en", rng.choice("aab"), i) for i in range(10, 400)]
    out += [(1000 + i, f"t {i}", "en", "long", None) for i in range(700)]
    return [(i, t, g, s, n, "x", 1, 2, "d", 3, "p", "other") for i, t, g, s, n in out]


@pytest.fixture(scope="module")
def docs(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")            # only to build the clash
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    spark.conf.unset("spark.sql.caseSensitive")
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0), "x") for i in range(1, 300)] + [(10, 1, 1, "x"), (None, 1, 1, "x")],
                                 "doc_id long, quality int, toxic int, part string")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row):
    i, t, g, s, n = row[:5]
    return H(*map(encoded, (i, s, g, n, t)))


def climb(nodes, at):
    """Root of a list of digests and the siblings of node ``at``, run by run."""
    steps = []
    while len(nodes) > 1:
        run = at // 16 * 16
        steps.append((nodes[run:at], nodes[at + 1:run + 16]))
        nodes, at = [H(*nodes[k:k + 16]) for k in range(0, len(nodes), 16)], at // 16
    return nodes[0], steps


def test_manifest(docs):
    parts = defaultdict(list)
    for r in rows():
        parts[r[3]].append(r)
    order = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    for p in parts.values():
        p.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    subroots = [climb([leaf_of(r) for r in parts[s]], 0)[0] for s in order]
    want = Counter()
    for k, s in enumerate(order):
        leaves = [leaf_of(r) for r in parts[s]]
        root, top = climb(subroots, k)
        for at, r in enumerate(parts[s]):
            steps = climb(leaves, at)[1] + top
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            fold = leaf_of((r[0], r[1] and r[1].translate(LOWER), *r[2:])) if bad else leaves[at]
            for before, after in steps:
                fold = H(*before, fold, *after)
            want[r[0], leaves[at], subroots[k], root, H(*[x for b, a in steps for x in b + a]), fold, fold == root] += 1
    got = manifest(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert Counter(map(tuple, got)) == want
    assert {v[-1] for v in want} == {True, False}


def test_manifest_nodes(docs, none):
    """A version's copied nodes run from its leaf to the root that it folds to."""
    got = manifest(docs, with_nodes=True).where("doc_id >= 1000").collect()
    assert {len(r.copied) for r in got} == {5} and all(r.copied[-1] == r.folded_root for r in got)      # 700 -> 44 -> 3 -> 1 -> parts
    assert all(r.copied[0] == r.leaf for r in got if r.verified)
    assert manifest(none).collect() == []


def test_versions_share_nodes():
    old = grown([str(i) for i in range(40)], 2)
    copied = version(old, 17, "new", 2)
    assert copied[-1].digest == grown([str(i) if i != 17 else "new" for i in range(40)], 2).digest
    new = copied[-1]
    assert [a is b for a, b in zip(old.children, new.children, strict=True)] == [True, False, True]
    assert sum(a is not b for a, b in zip(old.children[1].children, new.children[1].children, strict=True)) == 1


def test_filter_audit(docs, labels, none):
    quality, toxic = {}, {}
    for i, q, t, _ in labels.collect():
        if i is not None:
            quality[i], toxic[i] = max(quality.get(i, 0), q), max(toxic.get(i, 0), t)
    first = {}
    for r in rows():
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    marked = []
    for r in rows():
        t = r[1] or ""
        w = WORD.findall(t)
        fails = {c for c, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)),
            r[0] is not None and r[0] > first[t]), strict=True) if bad}
        marked.append((r[3] or "", fails, quality.get(r[0], 0), toxic.get(r[0], 0)))
    want, shapley = {}, Counter()
    for part in {m[0] for m in marked}:
        own = [m for m in marked if m[0] == part]
        for order in itertools.permutations("ABCDE"):
            left, gone = own, []
            for k, c in enumerate(order):
                out = [m for m in left if c in m[1]]
                left = [m for m in left if c not in m[1]]
                want[part, "".join(order), k + 1] = (len(left), len(out), sum(c in m[1] for m in gone), sum(m[1] == {c} for m in own),
                                                     sum(m[2] for m in out), sum(m[3] for m in out))
                shapley[part, c] += len(out)
                gone = gone + out
    got = filter_audit(docs, labels).collect()
    assert len(got) == len(want) == 120 * 5 * len({m[0] for m in marked})
    for r in got:
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == want[r.part, r.filter_order, r.step]
        assert r.shapley == shapley[r.part, r.filter_order[r.step - 1]]
    assert filter_audit(none, labels).collect() == []


def test_lm_scores(docs, none):
    held = {r[0]: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows()}
    tokens = [(r[0], WORD.findall((r[1] or "").translate(LOWER)) + [None]) for r in rows()]
    counts = Counter(w for i, t in tokens if not held[i] for w in t)
    total, types = sum(counts.values()), len(counts)
    want = Counter((i, held[i], len(t), sum(counts[w] > 0 for w in t), total,
                    round(sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in t), 6)) for i, t in tokens)
    got = score(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
    ours, base = (sum(getattr(r, c) for r in got if r.held_out) for c in ("score", "base_score"))
    assert ours > base
    assert score(none).collect() == []


def test_lm_without_training_text(docs):
    got = score(docs, learn_from=lambda i: F.lit(False)).collect()
    assert all(abs(r.score) < 1e-2 for r in got) and {r.train_tokens for r in got} == {0} and {r.n_known for r in got} == {0}


def test_maxent_is_a_distribution():
    """Chances of all leaves add up to 1 after learning, and learning helps."""
    rng = np.random.default_rng(1)
    leaf = rng.integers(0, 40, 20_000).astype(np.int32) * 25
    leaf[1::2] = (leaf[::2] + 25) % 1000                          # every other word follows from the one before
    keys, place = leaf.astype(np.uint64) * np.uint64(977), np.arange(len(leaf))
    mass = np.bincount(leaf, minlength=1024)
    model = maxent.MaxEnt(mass)
    features = maxent.histories(keys, place, 0, len(leaf))
    before = model.score(features, leaf).mean()
    learner = maxent.Learner(model, 0.5, 1.0)
    for _ in range(5):
        learner.step(features, leaf)
    assert model.score(features, leaf).mean() > before + 0.5
    some = features[:, :3]
    whole = sum(np.exp(model.score(some, np.full(3, k, np.int32))) for k in range(1024))
    assert np.allclose(whole, 1, atol=1e-4)
