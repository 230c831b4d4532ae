"""Intermediate rows that the third review's time findings come from."""

from pyspark.sql import functions as F
from test_findings_r03 import executed

from sourcinglens.operators import filters as fl
from sourcinglens.plans import flows


WORDS = [f"word{c}" for c in "abcdefghijklmnopqruv"]


def test_code_scores_form_no_row_per_similar_term(spark):
    """requests x labels x terms x similar terms are never rows."""
    requests = spark.createDataFrame([(f"q{i}", "copper valve") for i in range(20)], "request_id string, product string")
    codes = spark.createDataFrame([("C", f"c{i}", f"valve {WORDS[i]}", 1) for i in range(20)],
                                  "classification string, code string, label string, relevant int")
    terms = ["copper", "valve", *WORDS]
    near = [(t, f"near{k}", 0.01) for t in terms for k in range(200)]
    sims = spark.createDataFrame([*near, *[(b, a, s) for a, b, s in near], *[(t, t, 1.0) for t in terms], *[(a, b, 0.1) for w in WORDS for a, b in (("copper", w), (w, "copper"))]],
                                 "t1 string, t2 string, sim double")
    df = flows.code_scores(requests, codes, sims)
    assert df.count() == 400
    rows = sorted(((n, name) for name, n in executed(df)), reverse=True)[:4]
    assert rows[0][0] <= 2 * sims.count(), rows


def text_rows(df):
    """Rows that the joins of the plan made with the texts in them."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        rows = node.metrics().get("numOutputRows")
        if "Join" in node.nodeName() and "texts#" in node.output().mkString(",") and rows.isDefined():
            most = max(most, rows.get().value())
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_texts_are_joined_once_for_all_their_terms(spark):
    """a text isn't repeated for each term that it may hold."""
    terms = spark.range(300).select(F.concat(F.lit("term"), F.col("id") + 1000).alias("term"))
    words = " ".join(f"term{i}" for i in range(1000, 1300, 2)) + " term10 01 ab"
    texts = spark.range(20).select("id", F.array(F.lit(words), F.lit("term1001")).alias("texts"))
    more = spark.createDataFrame([("ab",), ("zz",), ("10 ",), ("m100 ",)], "term string")
    df = fl._holders(texts, "id", terms.unionByName(more))
    got = {(r.id, r.term) for r in df.collect()}
    asked = [f"term{i}" for i in range(1000, 1300)] + ["ab", "zz", "10 ", "m100 "]
    assert got == {(i, t) for i in range(20) for t in asked if t in words or t in "term1001"} and df.count() == len(got)
    assert text_rows(df) <= 40
