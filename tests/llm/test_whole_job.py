"""Cases in which an operator did less than its whole job."""

from collections import Counter

import corpus_pipeline as pipe
from rows import SMALL

from panelspark.llm import decontaminate as D
from panelspark.llm import html_text as H
from panelspark.llm import minhash_dedup as M
from panelspark.llm import personal_data as N


def test_disclosing_terms_go_wherever_they_stand(spark):
    far = "then came a great many other words between them before "
    rows = [(i, f"in part {i} we saw zorblatt write to boss@corp.example.com on day {i} of it, {far} Zorblatt é zorblatt left") for i in range(4)]
    rows += [(10 + i, f"boss@corp.example.com is where one writes on day {i} and {far} zorblatt reads") for i in range(2)]
    rows += [(20 + i, f"on day {i} nobody but zorblatt was here") for i in range(3)]
    rows += [(100 + i, f"we saw nothing on day {i} of it and {far} write to nobody where one is in part or reads, left") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in N.find_personal_data(df).collect():
        text = dict(rows)[r["doc_id"]]
        got = [text[int(s) : int(e)] for k, s, e in (x.split(":") for x in r["spans"].split(",") if x) if k == "term"]
        assert got == [w for w in text.replace(",", "").split() if w.lower() == "zorblatt"]
    assert not any("zorblatt" in r["text"].lower() for r in N.sanitise(df).collect())


def test_elements_whose_names_begin_alike_or_without_end_tag():
    page = """<body><svg-icon name=x></svg-icon><title-bar>Top</title-bar><svg viewBox="0 0 1 1"/><datalist><option value=a><option value=b>c</datalist>
    <option value=x><video src=y><p>One two three.</p><button-group>four</button-group><select><option>no<option>not</select>
    <svg><title>no</title></svg><option>neither</option><p>five six</p><title>rest</body>"""
    assert H.main_text(page, {"other": 0.0}) == "Top\nOne two three.\nfour\nfive six"


def test_wrappers_whose_class_has_a_word_of_furniture():
    words = "several words of the story "
    page = f"""<div class="layout has-sidebar"><h1 class="entry-header-title">The whole title of it</h1><p>{words * 9}</p><div class="sidebar"><p>{words}</p></div>
    <div class="site-footer"><a href=x>About</a> <a href=y>Us</a></div></div><section id="comments"><p>{words * 30}</p></section>"""
    weights = {"div": -1.0, "/div": -1.0}
    assert H.main_text(page, weights) == "The whole title of it\n" + (words * 9).strip()
    assert H.main_text(f'<div class="main widget"><article><p>{words}</p></article></div>', {}) == words.strip()


def test_options_without_end_tags():
    assert H.main_text("a<option>no<option>no</option><p>b", {}) == "a\nb"


def test_benchmark_items_without_an_id(spark):
    rows = spark.createDataFrame([(1, "so one two three four"), (2, "one two"), (3, "a b c d")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two three"), (7, "B c"), (None, None)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in D.decontaminate(rows, items).collect()}
    assert got == {1: (3, [None]), 2: (0, []), 3: (2, [7])}


def test_ids_near_the_largest(spark):
    top = 9_223_372_036_854_775_000
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(top + i, f"{text} and {i}") for i in range(4)] + [(-top, "something else here"), (top + 9, f"{text} and 1")]
    got = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {top: top, top + 1: top, top + 2: top, top + 3: top, top + 9: top, -top: -top}


def test_rows_without_an_id_are_judged_alone(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    rows = [(None, "clean words of no exam"), (None, f"so {item} ends"), (None, None), (1, f"see {item}"), (2, "clean too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    got = sorted(map(str, (tuple(r)[:2] for r in pipe.drop_contaminated(spark, docs, SMALL).collect())))
    assert got == sorted(map(str, [rows[0], rows[2], rows[4]]))


def test_of_rows_with_one_id_one_stays(spark):
    rows = [(1, "b one two three four five"), (1, "a one two three four five"), (2, "other words entirely than those"), (None, "x"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    out = pipe.drop_near_duplicates(spark, docs, SMALL)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == [(0, "x"), (0, "x"), (1, "a one two three four five"), (2, "other words entirely than those")]


def test_tags_without_an_end_take_linear_time():
    import time

    for piece in ("<div ", "<a href=\"", "</b ", "<!x ", "<p><!-- ", "</span>", "<div>"):
        start = time.process_time()
        H.main_text("<p>one two three " + piece * (2_000_000 // len(piece)), {})
        assert time.process_time() - start < 20, piece
    assert H.main_text("<p>one two</p> three <div four", {}) == "one two\nthree <div four"
    assert H.main_text("<p>one two</p><!-- > three", {}) == H.main_text("<p>one two</p><!-- three", {}) == "one two"
    assert H.main_text("<p>one two</p><script>x > 1; three", {}) == "one two"


def test_articles_without_an_article_element(spark):
    """Lists and tables within the text stay although no labelled region has them, and nothing behind them is lost."""
    words = "several words of the story that is told here and goes on "
    body = f"<p>{words * 8}</p><ul><li>{words}</li><li>{words}</li></ul><p>{words * 8}</p><table><tr><td>{words}</td></tr></table><p>{words * 8}</p>"
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    weights = H.learn_weights(pages)
    assert all(H.LEAST <= w <= 0 for name, w in weights.items() if name != "word")
    menu = "<div><a href=x>Home</a> <a href=y>News</a> <a href=z>Sport</a></div>"
    got = H.main_text(f"<html><body>{menu}<div class=body>{body}</div>{menu}</body></html>", weights)
    assert got == "\n".join(x.strip() for x in (words * 8, words, words, words * 8, words, words * 8))


def test_held_out_pages_without_their_labels(spark):
    """The scan alone, on pages whose article and main tags are renamed, finds most of what the labels say."""
    import re

    pages = [r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    weights = H.learn_weights(spark.createDataFrame([(p,) for p in pages[::2]], "html string"))
    found = kept = lost = 0
    for p in pages[1::2]:
        want = H.main_text(p, weights).split()
        got = H.main_text(re.sub(r"<(/?)(?:article|main)\b", r"<\1div", p), weights).split()
        both = sum((Counter(want) & Counter(got)).values())
        found, kept, lost = found + both, kept + len(got), lost + len(want)
    assert found >= 0.95 * lost and found >= 0.8 * kept


def test_adverts_within_an_article():
    words = "several words of the story that is told here " * 9
    page = f'<article><h1>Title of it</h1><p>{words}</p><p class="promo-box">Buy now</p><div id=ad-slot-3>More</div><p class="intro-text">End of it</p></article>'
    assert H.main_text(page, {}) == f"Title of it\n{words.strip()}\nEnd of it"
