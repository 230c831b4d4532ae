"""Trained operators on held-out rows, and the pipeline against a plain one."""
import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from sourcinglens.llm import html_extract as hx
from sourcinglens.llm.boosting import Boosted
from sourcinglens.llm.dom import parse
from sourcinglens.llm.quality_cnn import Network, accepted, chunks, classify, echo

SF = "/root/testdata/sf0.01"


def test_network_covers_the_whole_text():
    net = Network()
    text = np.frombuffer(("word " * 3000 + "&&&").encode(), np.uint8)
    padded, e = chunks(text)
    assert len(padded) >= len(text) and len(e) == (len(padded) - 8) // 4 + 1
    assert net.score(text) != net.score(text[:-3])
    assert echo(np.frombuffer(b"abc " * 40, np.uint8)).max() == 4.0 and 0 <= net.score(text[:0]) <= 1


def test_gradient_is_the_slope():
    net, rng = Network(3), np.random.default_rng(1)
    data = chunks(rng.integers(1, 255, 200).astype(np.uint8))
    for part, grad in zip(net.parts(), net.gradient(*data, 1), strict=True):
        for at in [tuple(x) for x in np.argwhere(np.abs(grad) > 1e-3)[:5]]:
            old, losses = part[at], []
            for step in (1e-2, -1e-2):
                part[at] = old + step
                pooled = net.responses(*data).max(0) + net.bias
                z = float(np.maximum(pooled, 0) @ net.dense + net.offset[0])
                losses.append(np.log1p(np.exp(-z)))
            part[at] = old
            assert abs((losses[0] - losses[1]) / 2e-2 - grad[at]) < 0.05 + 0.2 * abs(grad[at])


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = classify(docs, labels)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").where("held_out").select("predicted", "quality", "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    assert sum(r.quality == 1 and r.predicted == 0 for r in rows) <= 1


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (None, None, "y"), (1, "a", "z"), (2, "", None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    got = classify(docs, labels).collect()
    assert Counter((r.doc_id, r.score, r.predicted) for r in got) == Counter({(1, 1.0, 1): 2, (None, 1.0, 1): 1, (2, 1.0, 1): 1})
    assert classify(docs.limit(0), labels).count() == 0 and accepted(docs, labels).columns == docs.columns
    assert {r.score for r in classify(docs, labels.limit(0)).collect()} == {0.5}


def test_boosted_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5))
    y = (x[:, 0] > 0.5).astype(int) + (x[:, 1] > 0.7) * (x[:, 0] > 0.5)
    model = Boosted(3, rounds=10).fit(x[:1500], y[:1500])
    assert np.mean(model.log_probabilities(x[1500:]).argmax(1) == y[1500:]) > 0.97


def test_parser_is_tolerant():
    root = parse("<p>a<b>b<p>c<ul><li>1<li>2</ul><script>if (a<b) '</p>'</script><!-- x --><a href=q>d&amp;e</a>")
    tags = [n.tag for n in root.parts if not isinstance(n, str)]
    assert tags == ["p", "p", "ul", "script", "a"] and root.parts[-1].parts == ["d&e"]


def test_decoding_never_contradicts():
    rng = np.random.default_rng(4)
    for _ in range(30):
        blocks = hx.blocks_of(parse(hx.render(rng, ["some words of a text, and more of them. " * 20])))
        labels = hx.decode(blocks, rng.normal(size=(len(blocks), 3)))
        number = {id(b): i for i, b in enumerate(blocks)}
        assert all(labels[i] >= labels[number[id(b.parent)]] for i, b in enumerate(blocks) if b.parent)


def test_main_text_on_held_out_layouts(spark):
    texts = hx.training_texts(spark.read.parquet(f"{SF}/pages.parquet"), sample=100)
    assert 0 < len(texts) <= 100
    model, rng = hx.fit(texts, pages=300), np.random.default_rng(77)
    same = []
    for _ in range(150):
        page = hx.render(rng, texts)
        blocks = hx.blocks_of(parse(page))
        want = hx.text_of(blocks, [{"O": 0, "M": 1, "B": 2}.get(b.label, 0) for b in blocks])
        same.append(list(hx.extract(model, [page]))[0] == want)
    assert np.mean(same) >= 0.9


def test_main_text_of_given_pages(spark):
    import html
    import re
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in hx.main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:p|h1)>", inner))
        want = "\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)
    odd = spark.createDataFrame([(1, None, None, 1), (2, "u", "", 2), (2, "u", "<p>x", 2)], "page_id long, url string, html string, text int")
    assert all(r.n_chars == len(r.text) for r in hx.main_text(odd).collect()) and hx.main_text(odd.limit(0)).count() == 0


@pytest.mark.filterwarnings("ignore")
def test_pipeline_against_a_plain_one(spark, tmp_path):
    import corpus_pipeline as pipeline
    import tiktoken

    from sourcinglens.llm.mixing import mix
    from test_operators import brute_groups, normal, rows
    table = [r[:5] for r in rows() if r[0] is not None and r[0] != 3] + [(3, "same text hÉre", "en", "s1", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(table, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    got = Counter(tuple(r) for r in pipeline.run(spark, str(tmp_path)).collect())

    kept = {}
    for r in table:                                                  # one label only: all pass stage 1
        kept[normal(r[1])] = max(kept.get(normal(r[1]), r), r, key=lambda x: x[0])
    kept = sorted(kept.values())
    named = {i for i, _, c in brute_groups(kept) if i == c}
    kept = [r for r in kept if r[0] in named]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    times = {r.doc_id: int(r.taken / r["size"] + 0.5) if r["size"] else 0 for r in mix(spark.createDataFrame(kept, schema)).collect()}
    want = Counter()
    for r in kept:
        ids = library.encode_ordinary(r[1] or "")
        row = (r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())
        want[row] += times[r[0]]
    assert got == +want
