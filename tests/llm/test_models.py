"""Main text of pages, toxicity, and the pipeline."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlife.llm import decontaminate, htmltext, toxicity
from fleetlife.llm.htmltext import main_text
from fleetlife.llm.textparts import slices

from .conftest import VISIBLE, brute_components

LONG = "This is a long paragraph of the story, with many words and without any links in it at all. " * 3


def page(body):
    return f"<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


ARTICLE = f"<h1>Head &amp; line</h1><p>{LONG}</p><p>Short.</p><ul><li>one</li><li>two<li>three</ul><p>Caf&eacute;\n\n &#8364; <b>bold</b><br>x"
TEXT = "\n\n".join(["Head & line", LONG.strip(), "Short.", "one", "two", "three", "Café € bold x"])
AROUND = (
    "<header><a href=/>Site</a></header><nav><ul><li><a href=/a>Menu a</a><li><a href=/b>Menu b</a></ul></nav>"
    "<div class='cookie-notice'>We use cookies. {long}</div><div class=ad>Buy now, it is cheap! {long}</div>"
)
AFTER = (
    "<aside><p>Sidebar {long}</p></aside><form><label>Name</label><input></form>"
    "<section id='comments'><p>First! {long}</p></section><footer>&copy; 2024</footer>"
)


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div id=content>{}</div>", "<div class=outer><div class=post>{}</div></div>"])
def test_article_without_the_rest(wrap):
    html = page(AROUND.format(long=LONG) + wrap.format(ARTICLE) + AFTER.format(long=LONG))
    assert main_text(html)[0] == TEXT


@pytest.mark.parametrize(
    "wrap",
    [
        "<div class='content-sidebar-wrap'><main>{}</main></div>",
        "<main class='content has-sidebar'>{}</main>",
        "<main class='content with-ads sidebar'>{}</main>",
        "<article class='post comments-open'>{}</article>",
        "<article class='comments-open'>{}</article>",
        "<div class='entry-content ad-free'>{}</div>",
        "<div id='app' class='menu-open'><article>{}</article></div>",
        "<div id='app' class='nav-fixed'><div>{}</div></div>",
        "<div class='sidebar-layout'><div class='ad-wrapper'>{}</div></div>",
        "<div class='comments-wrap'><main>{}</main></div>",
    ],
)
def test_names_of_wrappers_do_not_lose_the_article(wrap):
    around, after = AROUND.format(long="Short notice."), AFTER.format(long="Short remark.")
    assert main_text(page(around + wrap.format(ARTICLE) + after))[0] == TEXT


def test_articles_of_comments_are_left_out():
    comments = "".join(f"<article id=div-comment-{i} class=comment-body><p>{LONG}</p></article>" for i in range(9))
    for inner in (comments, comments.replace("comment-body", "x").replace("div-comment", "y")):
        html = page(f"<article class='post comments-open'>{ARTICLE}</article><div id=comments class=comments-area>{inner}</div>")
        assert main_text(html)[0] == TEXT
    assert main_text(page(f"<div class=ads>{LONG}</div><div class=sidebar>{LONG}</div><div class=promo>{LONG}</div>"))[0].count(LONG.strip()) == 3


def test_menu_without_a_name_is_left_out():
    links = "".join(f"<div><a href=/{i}>Some other page {i}</a></div>" for i in range(20))
    html = page(f"<div><div>{links}</div><div>{ARTICLE}</div></div>")
    assert main_text(html)[0] == TEXT


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("plain  text & more", "plain text & more"),
        ("<p>a<p>b</div></span>c", "a\n\nbc"),
        ("<article></article>", ""),
        ("<body><script>x()</script></body>", ""),
        ("<div>" * 3_000 + "deep" + "</div>" * 3_000, "deep"),
        ("a < b and <3", "a < b and <3"),
        ("<p>x</p><!-- <p>no</p> --><p>y", "x\n\ny"),
    ],
)
def test_awkward_pages(html, text):
    assert main_text(html)[0] == text


def test_pages_of_the_table(spark, sf):
    """Generated pages hold their article in one element: its blocks are the whole answer."""
    import html
    import re

    from fleetlife.llm.queries import QUERIES

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op1_html"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id] or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", inner[1]) if inner else []
        plain = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks)
        assert r.text == "\n\n".join(b for b in plain if b) and r.n_chars == len(r.text)


def test_extra_columns_of_pages(spark):
    pages = spark.createDataFrame([(1, "<p>x</p>", "own", "own")], "page_id long, html string, main_text string, url string")
    row = htmltext.extract_main_text(pages).first()
    assert (row.main_text, row.url) == ("x", "own")


# --- toxicity ---


@pytest.fixture(scope="module")
def judged(spark):
    """Toxic only if an insult and a group stand together; each of them alone is harmless."""
    rng = random.Random(11)
    rows = []
    for i in range(3_000):
        words = rng.choices([f"w{k}" for k in range(300)], k=rng.randint(3, 30))
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["vermin"] * insult + ["strangers"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    rows += [(5_000, None, None), (5_001, "", 0), (None, "vermin strangers", 1), (7, "w1", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_pairs_are_learned(judged):
    docs, labels = judged.select("doc_id", "text"), judged.select("doc_id", "toxic")
    machine = toxicity.train(docs, labels)
    scored = toxicity.score(judged, machine).where(toxicity.is_held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    wrong = scored.where((F.col("toxicity") >= toxicity.REJECT) != (F.col("toxic") == 1)).count()
    assert scored.count() > 900 and wrong < 0.03 * scored.count()
    everything = toxicity.score(judged, machine)
    assert everything.count() == judged.count() and everything.where(~F.col("toxicity").between(0, 1)).count() == 0


def test_scores_depend_on_text_alone(spark, judged):
    machine = toxicity.train(judged.select("doc_id", "text"), judged.select("doc_id", "toxic"))
    changed = judged.select((F.col("doc_id") + 3).alias("doc_id"), "text", F.lit("x").alias("toxicity"))
    one = Counter((r.text, round(r.toxicity, 12)) for r in toxicity.score(judged, machine).collect())
    assert one == Counter((r.text, round(r.toxicity, 12)) for r in toxicity.score(changed, machine).collect())


def test_held_out_labels_do_not_matter(judged):
    flipped = judged.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(d.select("doc_id", "text"), d.select("doc_id", "toxic")) for d in (judged, flipped))
    assert (a.feature == b.feature).all() and a.intercept == pytest.approx(b.intercept)


def test_without_labels(spark, empty):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    machine = toxicity.train(docs, none)
    assert all(r.toxicity < 0.01 for r in toxicity.score(docs, machine).collect())
    assert toxicity.score(empty, machine).count() == 0


def test_held_out_part_of_the_table(spark, sf):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    from fleetlife.llm.queries import QUERIES

    scored = QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out")
    wrong = scored.where("predicted <> toxic").count()
    assert scored.count() > 80 and wrong <= 0.08 * scored.count()  # 280 training rows


# --- pipeline ---


def words(text):
    return len(VISIBLE.findall(text or ""))


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    from .test_words import brute_hits

    kept = {}
    for number, (name, function) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        out = function(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        assert docs.columns[: len(columns)] == columns
        after = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        kept[name] = len(after)
        assert not Counter(set(after)) - Counter(set(before))
        if name == "near duplicates":
            component, _ = brute_components([x[:2] for x in before], corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILAR_PERCENT)
            assert Counter(after) == Counter(x for x in before if component[x[0]] == x[0])
        if name == "decontamination":
            clean = [x for x in before if not (lambda n, h, _: h and decontaminate.HIT_SHARE * h >= n)(*brute_hits(x[1], benchmark))]
            assert Counter(after) == Counter(clean)
        if name == "mixing":
            assert max(Counter(after).values()) <= 3
            total = sum(words(x[1]) for x in before)
            assert abs(sum(words(x[1]) for x in after) - total) <= 0.01 * total  # ten documents a source
    assert kept["sharding"] == kept["mixing"] and len(names) == 5
    assert docs.where("shard < 0 or shard > 23").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == kept["sharding"]


def test_pipeline_with_awkward_rows(spark, awkward, tmp_path, sf):
    """Null ids and texts, repeated rows, long texts and clashing columns go through all stages."""
    docs = awkward.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    for table in ("benchmark", "labels"):
        spark.read.parquet(f"{sf}/{table}.parquet").write.parquet(str(tmp_path / f"{table}.parquet"))
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        before, docs = docs.columns, spark.read.parquet(str(tmp_path / name))
        assert set(before) <= set(docs.columns)
    assert 0 < docs.count() <= 3 * awkward.count()


def test_slots_are_distinct_per_row():
    import pyarrow as pa

    part = next(slices(pa.RecordBatch.from_arrays([pa.array(["a a a abcdefgh", None, "a"])], ["text"]), "text"))
    rows, slot = toxicity.slots(part)
    assert len({*zip(rows.tolist(), slot.tolist())}) == len(rows) == 5  # a, the long word and its two beginnings; a
