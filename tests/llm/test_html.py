from heddle.llm import html_text as X


def test_parse_blocks():
    page = "<div>a&amp;b <b>c</b><p>d\n e<br>f<script>no <p></script><style>x</style><!-- no --><p>g<ul><li>h<li>i</ul>j &lt;k&gt;</div><p title='a>b'>l"
    assert [b.text for b in X.parse(page)] == ["a&b c", "d e f", "g", "h", "i", "j <k>", "l"]
    assert X.parse("") == [] and [b.text for b in X.parse("a < b")] == ["a < b"]
    assert [b.text for b in X.parse("x<script>never closed")] == ["x"]


def accuracy(pages):
    crf = X.model()
    right = total = 0
    for feats, labels in X.labelled(pages):
        got = crf.decode(feats)
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    return right / total


def test_held_out_accuracy():
    assert accuracy(X.labelled_pages(300, seed=77, unnamed=0)) > 0.985
    assert accuracy(X.labelled_pages(300, seed=78, unnamed=1)) > 0.85


def test_viterbi_is_the_best_labelling():
    import itertools

    crf = X.model()
    (t, s) = (crf.trans, crf.start)
    for feats, _ in X.labelled(X.labelled_pages(40, seed=5)):
        feats = feats[:9]
        e = [sum(crf.weights[crf.index[x]] for x in f if x in crf.index) for f in feats]

        def value(y):
            return s[y[0]] + sum(e[i] * y[i] for i in range(len(y))) + sum(t[a][b] for a, b in itertools.pairwise(y))

        best = max(itertools.product((0, 1), repeat=len(feats)), key=value)
        assert abs(value(tuple(crf.decode(feats))) - value(best)) < 1e-9


def test_query_shape(spark):
    page = (
        "<html><head><title>T</title></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=/a>Menu</a></ul></nav>"
        "<div class=cookie-banner>We use cookies.</div><article><h1>Title here</h1><p>First &amp; long   paragraph, with words.</p>"
        "<div class=ad>Buy now.</div><p>Second one\nfollows.</p></article><section id=comments><h3>Comments</h3><p>I agree with all of this, well said.</p></section>"
        "<form><p>Your mail</p><input></form><footer>&copy; 2024 Us.</footer></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<script>x</script>"), (1, "u", page)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = [tuple(r) for r in X.extract(df).collect()]
    text = "Title here\n\nFirst & long paragraph, with words.\n\nSecond one follows."
    assert sorted(got, key=str) == sorted([(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (3, "v", "", 0), (None, "w", "", 0)], key=str)
    assert X.extract(df.limit(0)).count() == 0


#: Pages written by hand in layouts that the generator doesn't make; main text between the marks.
LAYOUTS = [
    # a table of the nineties
    """<html><body bgcolor=white><table><tr><td colspan=2><a href=/>Home</a> | <a href=/news>News</a> | <a href=/links>Links</a></td></tr><tr><td width=120><a href=/a>Archive</a><br><a href=/b>Guestbook</a></td>
    <td>[[<h2>The old mill</h2><p>The mill at the river was built in 1821 by two brothers, and it ran until the flood of 1904 took the wheel away.</p><p>Today the building is a museum. It opens on Sundays, when the weather allows it.</p>]]</td></tr>
    <tr><td colspan=2>Copyright 1998. All rights reserved.</td></tr></table></body></html>""",
    # names that say little
    """<html><body><div class=x1><a href=/>Start</a><a href=/s>Shop</a><a href=/k>Cart</a></div><div class=x2><div class=x3>[[<h1>How to keep bees</h1><p>Bees need water, shelter and flowers from early spring on, and a keeper who leaves them alone most of the time.</p>
    <p>Begin with one hive. Look at it every week, write down what you see, and ask somebody who has done it for longer than you.</p><blockquote>A calm keeper has calm bees.</blockquote>]]</div></div>
    <div class=x4><p>Subscribe to our newsletter and get offers every week.</p></div><div class=x5><a href=/imprint>Imprint</a> <a href=/privacy>Privacy policy</a></div></body></html>""",
    # article in sections with a bar of tools and reader comments
    """<body><div role=banner><h3>Daily Post</h3></div><div id=page><article>[[<h1>Council votes for the bridge</h1>]]<div class=share-tools><a href=#>Share</a> <a href=#>Tweet</a></div>
    [[<section><p>After four hours of debate the council voted for the new bridge on Tuesday night, by eleven to nine.</p><p>Work is to begin in May, said the mayor, and it will take two years.</p></section>]]</article>
    <div id=comments><h4>3 comments</h4><div class=comment><p>About time, I have waited for this bridge all my life!</p></div><div class=comment><p>Who will pay for it?</p></div></div></div><footer><p>Contact the editors. All rights reserved.</p></footer></body>""",
    # a list as an article, a consent dialog first
    """<body><div class=consent-dialog><p>We and our partners use cookies to store data on your device.</p><button>Accept all</button></div><main>[[<h1>Five walks near the lake</h1><ol><li>The shore path, flat and easy, two hours.</li><li>Up to the chapel, steep, with a view of both valleys.</li>
    <li>Through the gorge, closed in winter.</li></ol><p>All of them begin at the station, where there is a map.</p>]]</main><aside><h3>You may also like</h3><ul><li><a href=/1>Ten lakes for a swim</a></li><li><a href=/2>Trains with a view</a></li></ul></aside></body>""",
]


def test_pages_written_by_hand():
    import re

    crf = X.model()
    right = total = 0
    for page in LAYOUTS:
        main = {b.text for piece in re.findall(r"\[\[(.*?)\]\]", page, re.S) for b in X.parse(piece)}
        blocks = X.parse(page.replace("[[", "").replace("]]", ""))
        assert len(main) > 2
        for b, y in zip(blocks, crf.decode(X.features(blocks)), strict=True):
            right += y == (b.text in main)
            total += 1
    print(right, total)
    assert right / total >= 0.85


def test_deep_and_long_pages():
    import time

    began = time.time()
    deep = "<div><span><b>" * 30_000 + "text" + "</b></span></div>" * 30_000
    assert [b.text for b in X.parse(deep)] == ["text"]
    long_ = "<p>" + "word " * 400_000 + "privacy</p>"
    (block,) = X.parse(long_)
    assert len(block.text) == 2_000_007 and "notice:0" in X.text_feats(block, 0, 1)
    assert time.time() - began < 20


def test_what_is_not_shown_is_no_text():
    page = "<body><noscript><p>Turn scripts on.</p></noscript><p>One.</p><svg viewBox='0 0 1 1'><text>drawn</text></svg><svg/><template><p>later</p></template><p>Two.</p><noscript>open"
    assert [b.text for b in X.parse(page)] == ["One.", "Two."]
