"""Pages whose right answer is written by hand, not made with our patterns."""
from sourcinglens.operators import html as hx

PAGE = ("<html><head><title>no</title>stray head text</head><body>It&#8217;s &#x1F600; &amp;#39; &#0; A&nbsp;B<script>x='</p>'</script>"
        "<img src=/a.png><img src=\"\"><img alt=x src=' b.png '><a href=/one>1</a><a href='two.html'>2</a>"
        "<a href=\"https://other.example/x\">3</a><a href=/f.gz>4</a><a href=#top>5</a></body></html>")


def test_hand_written_page(spark):
    df = spark.createDataFrame([(1, "https://s.example/dir/p.html", PAGE)], "page_id int, url string, html string")
    row = df.select(hx.visible_tokens("html").alias("t"), hx.image_sources("html").alias("i")).first()
    assert row.t == ["It\u2019s", "\U0001F600", "&#39;", "A", "B", "1", "2", "3", "4", "5"]
    assert row.i == ["/a.png", "b.png"]
    assert [(r.pos, r.link) for r in hx.page_links(df).orderBy("pos").collect()] == [
        (0, "https://s.example/one"), (1, "https://s.example/dir/two.html")]
