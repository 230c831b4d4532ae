"""R8 against a plain breadth-first walk, site by site."""
import random

from pyspark.sql import functions as F

from sourcinglens.operators.crawl import crawl_closure


def plain_walk(links, root, ok, budget):
    queue, depth, out, met = [root], {root: 0}, [], 0
    while queue and met < budget:
        page = queue.pop(0)
        out.append((page, depth[page], ok.get(page, False)))
        met += ok.get(page, False)
        for _, dst in sorted(links.get(page, [])):
            if dst not in depth:
                depth[dst] = depth[page] + 1
                queue.append(dst)
    return out


def test_closure_equals_a_plain_walk(spark):
    """Cycles, links met twice, pages without status, a site larger than all
    others, one whose budget is never met and one whose root is unknown."""
    rng = random.Random(3)
    links, roots, ok = {}, {}, {}
    for site, size in {"hot": 400, "small": 9, "alone": 1, "dead": 60}.items():
        pages = [f"{site}/{i}" for i in range(size)]
        roots[site] = pages[0]
        for p in pages:
            links[p] = [(k, rng.choice(pages)) for k in range(rng.randrange(7))]
            if rng.random() < 0.8:
                ok[p] = site != "dead" and rng.random() < 0.7
        links[pages[0]] += [(10 + k, p) for k, p in enumerate(pages[1:6])]
    edges = spark.createDataFrame([(s, d, k) for s, out in links.items() for k, d in out], "src string, dst string, pos int")
    start = spark.createDataFrame(list(roots.items()), "site string, page string")
    known = spark.createDataFrame(list(ok.items()), "page string, success boolean")
    for budget in (1, 5, 31):
        got = crawl_closure(edges, start, known, budget)
        rows = {(r.site, r.page, r.depth, r.success) for r in got.select("site", "page", "depth", "success").collect()}
        want = {(s, *row) for s, root in roots.items() for row in plain_walk(links, root, ok, budget)}
        assert rows == want and got.count() == len(want)
    assert crawl_closure(edges, start.where(F.lit(False)), known).count() == 0
