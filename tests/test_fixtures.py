"""Hand-made fixtures: a dump with one page per behaviour, coordinates, infobox, PageRank, category and search."""

import bz2
import gzip
import json
import threading
import time
import urllib.error
import urllib.request
from html import escape

import pytest
from pyspark.sql import functions as F

from tidegraph import answers, cli
from tidegraph.functions import coords, markup, text
from tidegraph.operators import category, charts, ordering, resolve, search
from tidegraph.operators.pagerank import pagerank
from tidegraph.operators.storage import stored
from tidegraph.plans.pipelines import parse_pages, rank_pages
from tidegraph.sources import readers, sinks

BOX = "{{Infobox film\n| name = Foo\n| released = {{Film date|1999|01}}\n| url = http://x/?a=b\n| note = [[A|b]]\n}}"
PAGES = [
    ("A", 1, None, "[[B|bee]] [[C#s]] [[C#s|see]] [[File:q.jpg|thumb|cap [[D]] more]] [[|z]] [[#s|q]]"), ("B", 2, None, "[[C]] [[C]] [[B]] [[R]]"), ("R", 3, "A", ""), ("R2", 4, "R", ""), ("R3", 5, "A#Part", ""),
    ("C", 6, None, "<!-- [[B]] --> [[R2]] <!-- \n[[A]] -->"), ("File:X", 7, None, "x"), ("Category:Y", 8, None, "x"), ("MediaWiki:Z", 9, None, "x"), ("L", 11, None, "[[de:Eins]] [[de:Zwei]] [[fr:Un]] [[pl:X]]"), ("I", 12, None, BOX), ("E", 13, None, ""),
]


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    body = "".join(f"<page><title>{escape(t)}</title><id>{i}</id>" + (f'<redirect title="{escape(r)}"/>' if r else "") + f'<revision><text xml:space="preserve">{escape(x)}</text></revision></page>' for t, i, r, x in PAGES)
    xml = f"<mediawiki><siteinfo><sitename>S</sitename></siteinfo>{body}</mediawiki>".encode()
    d = tmp_path_factory.mktemp("dump")
    (d / "d.xml").write_bytes(xml)
    (d / "d.xml.gz").write_bytes(gzip.compress(xml))
    (d / "d.xml.bz2").write_bytes(bz2.compress(xml))
    return d


@pytest.mark.parametrize("suffix", ["", ".gz", ".bz2"])
def test_dump_scan(spark, dump, suffix):
    got = {r.title: r for r in readers.read_dump(spark, str(dump / f"d.xml{suffix}")).collect()}
    assert set(got) == {t for t, *_ in PAGES} - {"File:X", "Category:Y"} and got["R"].redirect_to == "A" and got["B"].text == PAGES[1][3]


def test_parse_and_rank(spark, dump):
    pages = parse_pages(readers.read_dump(spark, str(dump / "d.xml")))
    got = {r.title: r for r in pages.collect()}
    assert {x.article_title: x["count"] for x in got["A"].text_links} == {"B": 1, "C#s": 1, "C": 1, "File:q.jpg": 1, "z": 1, "": 1}
    assert {x.article_title: x["count"] for x in got["B"].text_links} == {"C": 2, "B": 1, "R": 1}
    assert got["L"].language_titles == {"de": "Zwei", "fr": "Un"} and got["I"].release_year == 1999 and got["E"].release_year == -1
    assert got["I"].infobox.infobox_type == "film" and got["E"].infobox is None
    ranked, edges = rank_pages(pages)
    assert {(r.src, r.dst) for r in edges.collect()} == {(1, 2), (1, 6), (2, 6), (2, 1), (6, 1), (12, 1)}  # a comment over two lines stays, so C links to A
    rows = ranked.collect()
    assert abs(sum(r["rank"] for r in rows) - 1) < 1e-9 and sorted(r.order for r in rows) == list(range(1, len(rows) + 1))
    _, legacy = resolve.build_graph(pages, transitive=True, strip_section=True)
    assert (6, 1) in {(r.src, r.dst) for r in legacy.collect()}


def test_infobox_scanner():
    assert markup.parse_infobox(BOX) == ("film", {"name": "Foo", "released": "{{Film date|1999|01}}", "url": "b", "note": "[[A|b]]"})
    assert "note" not in markup.parse_infobox(BOX[:-3])[1] and markup.parse_infobox("none") is None
    assert set(markup.parse_infobox(BOX.replace("Foo", "a < b"))[1]) <= {"name"}


@pytest.mark.parametrize(("text", "want"), [
    ("{{Infobox a\n| url = http://x/?q=\n| b = c}}", ("a", {"url": "http://x/?q=", "b": "c"})), ("{{Infobox a | x = 1=2=}}", ("a", {"x": "2="})), ("{{Infobox a | x = {{y|1=2|3}}}} | z = 1", ("a", {"x": "{{y|1=2|3}}"})),
    ("{{Infobox {{b | x = 1 }} | y = 2 }}", ("{{b", {"x": "1"})), ("{{Infobox a = 1 | b | c = 2 | d = }}", ("a", {"c": "2"})), ("{{infobox a|b=1} }", ("a", {"b": "1} }"})), ("{{Infobox a | x = 1 | x = 2 | = 3}}", ("a", {"x": "2"})),
])
def test_infobox_values(text, want):
    assert markup.parse_infobox(text) == want


def test_many_links_of_a_page(spark):
    page = " ".join(f"[[T{k % 7000}|x]]" for k in range(20_000)) + " [[de:A]]" * 2000
    row = spark.createDataFrame([(page,), ("",), (None,)], "text string")
    began = time.time()
    got = row.select(F.size(markup.text_links(F.col("text"))), F.get(markup.text_links(F.col("text")), F.lit(0))["count"], markup.language_titles(F.col("text"))).collect()
    assert time.time() - began < 30
    assert got[0][:] == (7001, 3, {"de": "A"}) and got[1][0] == 0


def test_redirect_cycles(spark):
    hops = {"a": "b", "b": "c", "c": "a", "x": "a", "y": "y", "p": "q#s", "q": "r", "r": "End", "s": "End"}
    pages = spark.createDataFrame([(t, k, r) for k, (t, r) in enumerate(hops.items())], "title string, id long, redirect_to string")
    got = {r.title: r.target for r in resolve.redirect_map(pages, transitive=True, strip_section=True, max_rounds=5).collect()}
    assert got == {"p": "End", "q": "End", "r": "End", "s": "End"}
    chain = spark.createDataFrame([(str(k), k, str(k + 1)) for k in range(100)], "title string, id long, redirect_to string")
    assert {r.target for r in resolve.redirect_map(chain, transitive=True).collect()} == {"100"}
    with pytest.raises(RuntimeError):
        resolve.redirect_map(chain, transitive=True, max_rounds=2)


def test_repeated_ids_are_refused(spark):
    pages = spark.createDataFrame([("A", 1, None, []), ("B", 1, None, [])], "title string, id long, redirect_to string, text_links array<struct<article_title:string,count:int>>")
    with pytest.raises(ValueError, match="several articles have the id 1"):
        resolve.build_graph(pages)


@pytest.mark.parametrize(("text", "want"), [
    ("{{coord|51|30|26|N|0|7|39|W|display=title}}", (51.507222222222225, -0.1275)), ("{{coord|48|51|N|2|21|E|title}}", (48.85, 2.35)), ("{{coord|51.5|N|0.125|W|type:city|display=title}}", (51.5, -0.125)),
    ("{{coord|48.85|2.35|display=title}}", (48.85, 2.35)), ("{{coord|1|2|3|display=title}}", None), ("{{coord|51.5|0.1}}", None), ("{{coord|LAT|LONG|display=title}}", None),
])
def test_coordinates(spark, text, want):
    c = spark.range(1).select(coords.from_text(F.lit(text)).alias("c")).first().c
    assert (c and tuple(c)) == (want and pytest.approx(want))


def test_infobox_coordinates(spark):
    box = F.create_map(*[F.lit(x) for x in "latd 10 latm 30 latNS S longd 20 longEW W".split()])
    assert tuple(spark.range(1).select(coords.from_infobox(box).alias("c")).first().c) == (-10.5, -20.0)


@pytest.mark.parametrize(("text", "strict", "want"), [
    ("{{Infobox x| latd = 10 | latm = 30| latNS = S |longd = 20|longEW = W", False, (-10.5, -20.0)), ("| latd = 10 | latm = x | longd = 20", False, None), ("| latd = 10 | latm = x | longd = 20", True, (10.0, 20.0)),
    ("| latd =10 | longd = 20", False, None), ("| COORD = {{coord|1|2}} | latd = 3 | longd = 4", False, (1.0, 2.0)), ("| coord = {{coord|1|2|3}} | lat_d = 3 | long_d = 4", False, (3.0, 4.0)), ("| latd = 10 {{coord|5|6|title}}", False, (5.0, 6.0)),
    ("| latd = 1 | longd = 2 | longs = y", True, None),
])
def test_raw_coordinates(spark, text, strict, want):
    c = spark.range(1).select(coords.coordinate_raw(F.lit(text), strict).alias("c")).first().c
    assert (c and tuple(c)) == want


@pytest.mark.parametrize(("a", "b", "said"), [
    (1.0, 1.0, "x is about as influential as y"), (1.0, 1.04, "y is about as influential as x"), (3.0, 1.0, "x is 3x more influential than y"), (1.0, 2.54, "y is 2.5x more influential than x"),
    (1234.0, 1.0, "x is 1000x more influential than y"), (9.96, 1.0, "x is 10x more influential than y"), (0.0, 2.0, "y is Infinityx more influential than x"), (0.0, 0.0, "x is about as influential as y"),
])
def test_comparison(spark, a, b, said):
    row = spark.createDataFrame([("x", a, "y", b)], "x string, a double, y string, b double")
    assert row.select(search.said_of(F.col("x"), F.col("a"), F.col("y"), F.col("b"))).first()[0] == said


def test_numbers_as_text(spark):
    values = {0.0123: "0.012%", 0.0996: "0.10%", 1.0: "1.0%", 45.2: "45%", 123.0: "1.2e+2%", 1.5e-8: "1.5e-8%", 0.0: "0.0%"}
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in rows.select(text.percent_influence(F.col("v"), F.lit(1.0))).collect()] == list(values.values())
    assert spark.range(1).select(text.percent_influence(F.lit(1.0), F.lit(0.0))).first()[0] is None
    link = spark.range(1).select(text.page_link(F.lit("A & B"), "http://e.org/")).first()[0]
    assert link == '<a href="http://e.org/A_%26_B">A &amp; B</a>'


def graph(spark, names, edges):
    return spark.createDataFrame([(i,) for i in range(len(names))], "id long"), spark.createDataFrame([(names.index(a), names.index(b)) for a, b in edges], "src long, dst long")


def test_pagerank_goldens(spark):
    r = {x.id: x["rank"] for x in pagerank(*graph(spark, "ABCDE", ["AB", "AC", "BC", "CA", "DC"])).collect()}
    assert [r[k] for k in range(5)] == pytest.approx([0.3590480075, 0.1887583956, 0.3799044403, 0.0361445783, 0.0361445783], abs=1e-9)
    assert all(x["rank"] == pytest.approx(1 / 3) for x in pagerank(*graph(spark, "ABC", ["AB", "BC", "CA"])).collect())
    assert pagerank(*(d.limit(0) for d in graph(spark, "AB", ["AB"]))).count() == 0


def plain_pagerank(n, edges):
    degree, r, change = [sum(a == k for a, _ in edges) for k in range(n)], [1 / n] * n, 1.0
    while change > 1e-4:
        raw = [0.0] * n
        for a, b in edges:
            raw[b] += 0.85 * r[a] / degree[a]
        new = [x + (1 - sum(raw)) / n for x in raw]
        change, r = sum(abs(x - y) for x, y in zip(new, r, strict=True)), new
    return r


@pytest.mark.parametrize("kind", ["layers", "cycle behind a path", "any"])
def test_pagerank_steps(spark, monkeypatch, kind):
    """Where all walks end no step follows the last of them; where they don't, the dealt edges meet ranks unmoved and unsorted."""
    edges = {
        "layers": [(a, b) for a in range(12) for b in (12 + a % 5, 12 + a % 3)] + [(b, 17 + b % 2) for b in range(12, 17)] + [(17, 19), (18, 19)],
        "cycle behind a path": [(a, a + 1) for a in range(14)] + [(14, 13)], "any": [(a, (a * a + s) % 23) for a in range(23) for s in (1, 4, 9)],
    }[kind]
    edges, n, plans = sorted(set(edges)), 24, []

    def seen(df, label, **k):
        out = stored(df, label, **k)
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr("tidegraph.operators.pagerank.stored", seen)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {x.id: x["rank"] for x in pagerank(spark.range(n), spark.createDataFrame(edges, "src long, dst long")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert [got[i] for i in range(n)] == pytest.approx(plain_pagerank(n, edges), abs=1e-12)
    steps = [p for label, p in plans if label == "ranks"][1:]
    assert kind != "layers" or len(steps) <= 4
    for plan in steps:
        lines = plan.split("== Initial Plan ==")[0].splitlines()
        at = next(i for i, x in enumerate(lines) if "InMemoryTableScan" in x)
        above = "".join(lines[at - 3 : at])
        assert "SortMergeJoin" in above and "Exchange" not in above and "Sort [" not in above


def test_pagerank_of_ends_and_copies(spark):
    """Without vertices the ends of the edges are ranked, a null once and without walks; copies of an edge count once."""
    edges = [(0, 2), (0, 2), (1, 2), (2, 3), (0, 3), (0, 2), (2, 3)]
    want = plain_pagerank(4, sorted(set(edges)))
    got = {x.id: x["rank"] for x in pagerank(None, spark.createDataFrame(edges, "src long, dst long"), repeated=True).collect()}
    assert [got[i] for i in range(4)] == pytest.approx(want, abs=1e-12) and len(got) == 4
    odd = pagerank(None, spark.createDataFrame([*edges, (None, 3), (None, 3)], "src long, dst long"), repeated=True).collect()
    assert sorted(map(str, (x.id for x in odd))) == ["0", "1", "2", "3", "None"] and sum(x["rank"] for x in odd) == pytest.approx(1)
    assert pagerank(None, spark.createDataFrame([], "src long, dst long"), repeated=True).count() == 0


def test_category(spark, tmp_path):
    (tmp_path / "l.txt").write_bytes(b"A\r\nr\nNope\nC")
    titles = readers.read_titles(spark, str(tmp_path / "l.txt"))
    ranks = dict(zip("ABCDE", [0.3590480075, 0.1887583956, 0.3799044403, 0.0361445783, 0.0361445783], strict=True))
    pages = spark.createDataFrame([(i, t, ["R"] if t == "A" else [], ranks[t]) for i, t in enumerate("ABCDE")], "id long, title string, aliases array<string>, rank double")
    _, edges = graph(spark, "ABCDE", ["AB", "AC", "BC", "CA", "DC"])
    assert {r.title for r in category.members(pages, titles).collect()} == {"A", "C"}
    assert {r.title for r in category.unmatched(pages, titles).collect()} == {"r", "Nope"} and [r.title for r in category.unmatched(pages, titles, False).collect()] == ["NOPE"]
    doc = json.loads(sinks.json_document(category.category_table(pages, edges, titles, category.CategoryOptions(num_influencers=3))))
    assert [(d["title"], d["position"]) for d in doc] == [("C", 1), ("A", 2)] and doc[1]["pageRank"] == pytest.approx(0.3590480075 / (0.3590480075 + 0.3799044403))
    assert doc[0]["influencers"][0] == {"title": "A", "influence": pytest.approx(0.85 * ranks["A"] / 2 / ranks["C"])}


def test_prefix_search(spark):
    keys = [("hello1", 1.0), ("hello2", 2.0), ("hello3", 3.0), ("hello12", 12.0), ("blah", 1.0), ("bla", 2.0), ("bla你", 2.0), ("blee", 2.0), ("A B", 1.0), ("AHB", 1.0)]
    index = search.title_index(spark.createDataFrame([(i, k, r) for i, (k, r) in enumerate(keys)], "id long, title string, rank double"))
    found = lambda p, n=10: [r.key for r in search.suggest(index, p, n).collect()]
    assert found("h", 1) == ["HELLO12"] and len(found("bla")) == 3 and len(found("bl")) == 4 and found("blahhh") == found("dsdsdacdvdv") == [] and found("A ") == ["A B"]
    with pytest.raises(ValueError):
        search.compare_titles(index, ["a"])
    assert search.compare_titles(index, ["hello1", "hello12"]).first().ratio == 12


def test_ordering(spark):
    rows = ordering.ordered(spark.range(1000).select("id", (F.col("id") % 7).cast("double").alias("rank")))
    got = [r.id for r in ordering.order_range(rows, 0, 5000).orderBy("order").collect()]
    assert got == sorted(range(1000), key=lambda i: (-(i % 7), i)) and ordering.order_range(rows, 2000, 3000).count() == 0
    assert dict(rows.dtypes)["order"] == "bigint"
    near = ordering.leading(spark.range(1000).select("id", (F.col("id") % 7).cast("double").alias("rank")), 30, [F.desc("rank"), F.asc("id")], start=10).orderBy("position").collect()
    assert [(r.id, r.position) for r in near] == [(got[k], k + 1) for k in range(10, 30)]


def test_rounded_histogram(spark):
    import math

    values = [math.exp(x / 10) for x in range(0, 101)]
    rows = charts.rounded_histogram(spark.createDataFrame([(v,) for v in [*values, 0.0, -1.0]], "v double"), "v").orderBy("bucket").collect()
    assert len(rows) == 50 and rows[0].lower == 0 and rows[-1].upper == pytest.approx(10) and sum(r.n for r in rows) == 101 and sum(r.frequency for r in rows) == pytest.approx(1)
    assert charts.rounded_histogram(spark.createDataFrame([(2.0,)] * 3, "v double"), "v").where("n = 3").count() == 1
    assert charts.rounded_histogram(spark.createDataFrame([], "v double"), "v").count() == 0


@pytest.fixture(scope="module")
def ranked(spark):
    rows = [(1, "Alpha", ["First"], 0.5, 1, 1999), (2, "Beta", [], 0.25, 2, -1), (3, "Gamma <x>", ["beta"], 0.125, 3, -1)]
    return spark.createDataFrame(rows, "id long, title string, aliases array<string>, rank double, `order` long, release_year int")


def test_lookup_and_categories(spark, ranked):
    index = search.title_index(ranked)
    named = lambda *t: {r.title for r in search.pages_by_title(index, ranked, spark.createDataFrame([(x,) for x in t], "title string")).collect()}
    assert named("first", "ALPHA ", "?") == {"Alpha"} and named("BETA") == {"Beta"}  # of equal keys the greatest rank counts
    assert search.page_by_order(ranked, 2).first().title == "Beta" and search.page_by_order(ranked, 0).count() == search.page_by_order(ranked, 4).count() == 0
    assert [r.title for r in search.suggest_pages(index, ranked, "b").collect()] == ["Beta"]
    lists = spark.createDataFrame([("one", "alpha"), ("one", "First"), ("one", "beta"), ("two", "gamma <X>"), ("two", "?")], "category string, title string")
    got = [(r.category, r.title, r.position, r.percent_of_first) for r in search.category_tables(index, ranked, lists).orderBy("category", "position").collect()]
    assert got == [("one", "Alpha", 1, 0.0), ("one", "Beta", 2, 50.0), ("two", "Gamma <x>", 1, 0.0)]
    assert search.category_tables(index, ranked, lists, 1).count() == 2


def test_answers_over_http(spark, ranked):
    lists = spark.createDataFrame([("a & b", "alpha"), ("a & b", "Gamma <x>")], "category string, title string")
    with answers.server(answers.Answers(ranked, lists), 0) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{server.server_address[1]}"
        get = lambda path: urllib.request.urlopen(base + path).read().decode()
        assert [p["title"] for p in json.loads(get("/things?things[]=beta&things[]=first"))] == ["Beta", "Alpha"]
        assert [p["title"] for p in json.loads(get("/named_entity_suggestions?q=al"))["suggestions"]] == ["Alpha"]
        page = get("/")
        assert "a &amp; b" in page and "Gamma &lt;x&gt;" in page and "25.00" in page
        for bad, code in (("/things?things[]=beta", 400), ("/things?things[]=beta&things[]=zz", 400), ("/named_entity_suggestions", 400), ("/named_entity_suggestions?q=a&q=b", 400), ("/x", 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                get(bad)
            assert e.value.code == code
        server.shutdown()


def test_saved_sources(spark, tmp_path):
    (tmp_path / "links.json").write_text(json.dumps({"parse": {"links": [{"*": "A"}, {"*": "List of B"}]}}))
    got = readers.film_titles(readers.read_saved_links(spark, str(tmp_path / "links.json"))).collect()
    assert [(r.pos, r.title) for r in got] == [(0, "A")]
    (tmp_path / "ranked.json").write_text(json.dumps([{"Title": "A", "Rank": 0.5}, {"Title": "B", "Rank": 0.25}]))
    assert [tuple(r) for r in readers.read_ranked_json(spark, str(tmp_path / "ranked.json")).collect()] == [("A", 0.5), ("B", 0.25)]
    for name, body in (("x", "A\n B \n"), ("y", "C")):
        (tmp_path / name).write_text(body)
    lists = readers.read_categories(spark, {"X": str(tmp_path / "x"), "Y": str(tmp_path / "y")})
    assert {tuple(r) for r in lists.collect()} == {("X", "A"), ("X", "B"), ("Y", "C")} and readers.read_categories(spark, {}).count() == 0
    assert readers.row_count(lists) == 3


def test_commands(spark, dump, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    d = lambda name: str(tmp_path / name)
    run = lambda *a: (cli.main(list(a)), capsys.readouterr())[1]
    run("extract", str(dump / "d.xml"), d("pages"))
    run("rank", d("pages"), d("ranked"), d("edges"), "--float")
    assert dict(spark.read.parquet(d("ranked")).dtypes)["rank"] == "float"
    run("rank", d("pages"), d("ranked"), d("edges"))
    run("sort", d("ranked"), d("sorted"))
    (tmp_path / "list").write_text("A\nc\nNope\n")
    run("filter", d("ranked"), d("list"), d("filtered"))
    assert {r.title for r in spark.read.parquet(d("filtered")).collect()} == {"A", "C"}
    said = run("dumpcategory", d("ranked"), d("edges"), d("list"), d("doc.json"), "--influencers", "2", "--ignore-case", "--year", "--compact", "--no-aliases")
    doc = json.loads((tmp_path / "doc.json").read_text())
    assert "not found: NOPE" in said.err and {x["title"] for x in doc} == {"A", "C"} and set(doc[0]) == {"title", "pageRank", "position", "releaseYear", "influencers"}
    lines = run("print", d("ranked")).out.splitlines()
    assert len(lines) == spark.read.parquet(d("ranked")).count() and [float(x.rsplit(": ", 1)[1]) for x in lines] == sorted((float(x.rsplit(": ", 1)[1]) for x in lines), reverse=True)
    assert run("suggest", d("ranked"), "r").out.split("\t")[0] == "R" and "influential" in run("compare", d("ranked"), "A", "E").out
    assert json.loads(run("page", d("ranked"), "r").out)[0]["title"] == "A"
    run("tables", d("ranked"), d("tables"), f"letters={d('list')}")
    assert {(r.category, r.title) for r in spark.read.parquet(d("tables")).collect()} == {("letters", "A"), ("letters", "C")}
    run("extract", str(dump / "d.xml"), d("old-pages"), "--legacy")
    run("rank", d("old-pages"), d("old-ranked"), d("old-edges"), "--legacy")
    assert (6, 2) in {(r.src, r.dst) for r in spark.read.parquet(d("old-edges")).collect()}  # comments are kept
