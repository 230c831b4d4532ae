"""Each operator against a brute-force version on small tables with nulls,
empty and long texts, ties, repeated rows, clashing extra columns, and on empty
tables."""
import base64
import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sourcinglens.llm.bpe import encode_decode
from sourcinglens.llm.common import scratch_folder
from sourcinglens.llm.exact_dedup import exact_dedup, without_copies
from sourcinglens.llm.mixing import apportion, copies, mix
from sourcinglens.llm.ngram_join import jaccard_groups
from sourcinglens.llm.pii import replace_private
from sourcinglens.llm.quality_rules import quality_rules
from sourcinglens.llm.substring_dedup import substring_dedup
from sourcinglens.llm.token_counts import read_cache, token_counts

#: Extra columns with names the operators use inside, and one that differs in case only.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, DIGEST string, size long, n long, cls int, `Text` string"
BLANK = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text):
    return BLANK.findall((text or "").encode())


def rows():
    rng = random.Random(5)
    vocabulary = ["the", "of", "Alpha", "alpha", "bêta", "x#y", "3.14", "日本", "don't", "end.", "nine"]
    out = [(1, "Same Text here", "s1"), (2, "same text HERE", "s1"), (3, "same text hÉre", "s1"), (3, "same text hÉre", "s1"),
           (4, None, "s2"), (5, "", "s2"), (6, "  \n\t ", None), (None, "a null id", "s2"), (7, "one", None),
           (8, "a a a a a a a a", "s3"), (9, "l1 w\nl1 w\n\nl2\nl1 w\n", "s3"), (10, "two  words", "é"),
           (11, " ".join(rng.choice(vocabulary) for _ in range(3000)), "s1"), (12, "ab" * 3000, "s3")]
    base = [rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(90)]
    for i in range(13, 60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append((i, " ".join(w[rng.choice([0, 0, 40]):]) + ("\n" + " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 9, 70])))), f"s{i % 4}"))
    return [(i, t, "en", s, 0, "x", 1, 2, 3, "other") for i, t, s in out]


@pytest.fixture(scope="module")
def docs(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")            # only to build the clash
    df = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    spark.conf.unset("spark.sql.caseSensitive")
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def normal(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("digest", ["sha", "weak"])
def test_exact_dedup(docs, digest):
    options = {} if digest == "sha" else {"digest": lambda t: F.crc32(t.cast("binary")) % 3}     # clashes on purpose
    got = [tuple(r) for r in exact_dedup(docs, **options).drop("twins").collect()]
    groups = defaultdict(list)
    for r in rows():
        groups[normal(r[1])].append(r[0])
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, keep[t], len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert Counter((a, b, c, e) for a, b, c, _, e in got) == want
    kept = Counter(e for _, _, _, k, e in got if k)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(a == b for a, b, _, k, _ in got if k)


def test_without_copies_keeps_columns(docs):
    out = without_copies(docs)
    assert out.columns == docs.columns
    assert sorted(normal(r[1]) for r in out.collect()) == sorted({normal(r[1]) for r in rows()})


def test_quality_rules_counts(docs):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
           for r in quality_rules(docs).collect()}
    want = set()
    for i, t, *_ in rows():
        w = words(t)
        at = defaultdict(list)
        for k in range(len(w) - 4):
            at[tuple(w[k:k + 5])].append(k)
        covered = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want.add((i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)),
                  len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)))
    assert got == want


def test_quality_rules_order_is_only_cost(docs):
    names = ["symbols", "word_length", "repeated_lines", "shouting", "capitals", "letters", "endless_word"]
    a = Counter(quality_rules(docs, order=names).select("doc_id", "kept").collect())
    assert a == Counter(quality_rules(docs, order=names[::-1]).select("doc_id", "kept").collect())


def brute_targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: Fraction(weights[i % 3]) for i, s in enumerate(order)}
    total, target, open_ = Fraction(3, 2) * sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        target.update({s: Fraction(2 * sizes[s]) for s in full} if full else share)
        open_ -= full if full else open_
    return target


def test_mix(docs):
    got = mix(docs).collect()
    again = mix(docs.repartition(2)).collect()
    assert Counter(got) == Counter(again)
    sizes = defaultdict(int)
    for i, t, _, s, *_ in rows():
        sizes[s] += len(words(t))
    source = {(i, len(words(t))): s for i, t, _, s, *_ in rows()}
    target, taken = brute_targets(sizes), defaultdict(int)
    for r in got:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and abs(r.target - float(target[s])) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - float(target[s])) <= 16 + 8 * 8 for s in sizes)


def test_copies_keep_columns(docs):
    out = copies(docs)
    assert out.columns == docs.columns
    assert max(Counter((r[0], r[1]) for r in out.collect()).values()) <= 4          # id 3 stands in two rows


def test_apportion_is_highest_quotients(spark):
    rng = random.Random(2)
    parts = [(g, p, rng.randrange(1, 5000), seats) for g, seats in ((0, 997), (1, 3), (2, 0)) for p in range(40)]
    df = spark.createDataFrame(parts, "g int, p int, v long, seats long")
    got = {(r.g, r.p): r.quota for r in apportion(df, ["g"], "v", "seats", ["p"]).collect()}
    for g in (0, 1, 2):
        mine = [(p, v) for gg, p, v, _ in parts if gg == g]
        seats = next(s for gg, _, _, s in parts if gg == g)
        quota = Counter()
        for _ in range(seats):
            p = max(mine, key=lambda x: (Fraction(x[1], 2 * quota[x[0]] + 1), -x[0]))[0]
            quota[p] += 1
        assert all(got[g, p] == quota[p] for p, _ in mine)


def test_bpe_against_the_library(docs):
    import tiktoken
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter(tuple(r) for r in encode_decode(docs, path, public_tokenizers.PATTERN).collect())
    want = Counter()
    for i, t, *_ in rows():
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    whole = encode_decode(docs, path, public_tokenizers.PATTERN, with_ids=True).where("doc_id = 11").first()
    assert whole.decoded == rows()[12][1] and whole.token_ids == library.encode_ordinary(whole.decoded)


def test_token_counts_and_cache(spark, docs):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(100, "a\n<|endoftext|>b  <|endoftext|> c"), (101, "  lead   and trail  ")], "doc_id long, text string")
    folder = scratch_folder(docs, "test-token-cache")
    got = Counter(tuple(r) for r in token_counts(docs, folder, path).collect())
    want = Counter()
    for i, t, *_ in rows():
        n = len(library.encode(t or "", add_special_tokens=False))
        want[i, len((t or "").encode()), n, n > 512] += 1
    assert got == want
    stored = read_cache(spark, folder).count()
    assert stored == len({t or "" for _, t, *_ in rows()})
    assert Counter(tuple(r) for r in token_counts(docs, folder, path).collect()) == want
    assert read_cache(spark, folder).count() == stored                                 # nothing encoded again
    assert {r.doc_id: r.n_tokens for r in token_counts(extra, folder, path).collect()} == {
        i: len(library.encode(t, add_special_tokens=False)) for i, t in ((100, "a\n<|endoftext|>b  <|endoftext|> c"), (101, "  lead   and trail  "))}


def test_substring_dedup(docs):
    first, want = {}, Counter()
    key = lambda i: i if i is not None else 1 << 63
    for i, t, *_ in rows():
        w = words(t)
        for k in range(len(w) - 49):
            first[tuple(w[k:k + 50])] = min(key(i), first.get(tuple(w[k:k + 50]), 1 << 64))
    for i, t, *_ in rows():
        w = words(t)
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k:k + 50])] < key(i) for j in range(50)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()] += 1
    assert any(n for _, _, n, *_ in want)
    assert Counter(tuple(r) for r in substring_dedup(docs, shard_bytes=4000, with_text=True).collect()) == want


def brute_groups(table, percent=90):
    sets = [(i, frozenset(tuple(w[k:k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset())
            for i, t, *_ in table for w in [words(normal(t))]]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a][1] & sets[b][1])
            if common and 100 * common >= percent * len(sets[a][1] | sets[b][1]):
                parent[find(a)] = find(b)
    members = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        members[find(a)].append(i)
    small = {r: min((i for i in m if i is not None), default=None) for r, m in members.items()}
    return Counter((i, len(s), small[find(a)]) for a, (i, s) in enumerate(sets))


@pytest.mark.parametrize("bucket", [64, 2])
def test_jaccard_groups(docs, bucket):
    got = jaccard_groups(docs, bucket=bucket, levels=2).drop("cls")
    assert Counter(tuple(r) for r in got.collect()) == brute_groups(rows())


def test_private_texts(spark):
    table = [(1, "Call +1 (826) 555-4081 190.137.223.204 du"), (2, "x.y@mail7.example.com X.Y@MAIL7.EXAMPLE.COM, 4111 1111 1111 1111 4111111111111111."),
             (3, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" thha'), (4, "Mrs. Anna Smith met Mr. Smith, господин Иванов"),
             (5, None), (6, ""), (7, "no 4.0.1 version 3. and 1234567890123456 999.1.1.1"), (8, "plain"), (2, "x.y@mail7.example.com"), (None, "ip 190.137.223.204")]
    table += [(100 + i, f"to a{i}@b.co and 10.0.0.{i}") for i in range(200)]
    df = spark.createDataFrame([(i, t, "n") for i, t in table], "doc_id long, text string, digest string")
    got = replace_private(df, "k").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, replace_private(df.repartition(3), "k").collect()))
    of = defaultdict(list)
    for r in got:
        of[r.doc_id].append(r)
    assert re.fullmatch(r"Call \+1 \(\d{3}\) \d{3}-\d{4} (\d+\.){3}\d+ du", of[1][0].text) and of[1][0].n_entities == 2
    assert of[None][0].text.split()[-1] == of[1][0].text.split()[-2]                                   # one entity, one surrogate
    lower, upper, *card = of[2][0].text.replace(",", "").rstrip(".").split() if len(of[2][0].text) > 40 else of[2][1].text.replace(",", "").rstrip(".").split()
    assert upper == lower.upper() and lower.endswith(".com") and "".join(card[:4]) == card[4]
    assert re.fullmatch(r'token = "[0-9a-f]{40}" thha', of[3][0].text) and "04dbebab" not in of[3][0].text
    title, given, family, _, mr, again, herr, cyrillic = of[4][0].text.replace(",", "").split()
    assert (title, mr, herr) == ("Mrs.", "Mr.", "господин") and given.endswith("a") and family == again != "Smith"
    assert re.fullmatch(r"[а-яА-Я]+", cyrillic)
    assert of[5][0].text is None and [of[i][0].text for i in (6, 7, 8)] == ["", table[6][1], "plain"]
    mails = {r.text.split()[1] for i in range(200) for r in of[100 + i]}
    assert len(mails) == 200 and not mails & {f"a{i}@b.co" for i in range(200)}


def test_empty_tables(none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert exact_dedup(none).count() == quality_rules(none).count() == mix(none).count() == jaccard_groups(none).count() == 0
    assert substring_dedup(none).count() == replace_private(none, "k").count() == 0
    assert token_counts(none, scratch_folder(none, "test-token-cache"), path).count() == 0
    assert encode_decode(none, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
