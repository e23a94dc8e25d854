import hashlib
import json

from pyspark.sql import functions as F

from stockpot.sources import files, pages
from stockpot.streaming import events


def test_envelope_files(spark, tmp_path):
    for i, text in enumerate(['{"schema_version": 1, "site": "s", "recipe": {"title": "t"}}', "{broken"]):
        (tmp_path / f"{hashlib.sha256(bytes([i])).hexdigest()}.json").write_text(text)
    (tmp_path / "other.json").write_text("{}")
    rows = files.read_envelopes(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and {r.recipe.title if r.recipe else None for r in rows} == {"t", None}
    out = spark.createDataFrame([("s", "t", None, ("a",))], "site string, crawled_at string, discovered_from string, recipe struct<title:string>")
    files.write_envelopes(out, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value)["recipe"] == {"title": "a"}


def test_lines_and_state(spark, tmp_path):
    p = str(tmp_path / "failed")
    files.append_lines(spark.createDataFrame([("u", "e")], "url string, error string"), p)
    files.append_lines(spark.createDataFrame([("v", "e")], "url string, error string"), p)
    (tmp_path / "failed" / "part-x.json").write_text('{"url": 5\n{"url": "w"}\n')
    assert {r.url for r in files.read_lines(spark, p, "url string, error string").collect()} == {"u", "v", "w"}
    files.save_state(spark, str(tmp_path / "state"), {"page": "3"})
    assert files.load_state(spark, str(tmp_path / "state")) == {"page": "3"} and files.load_state(spark, str(tmp_path / "none")) == {}
    files.write_export(spark.createDataFrame([(i, f"l{i}") for i in range(20, -1, -1)], "line_no long, line string"), str(tmp_path / "export"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "export")).collect()) == sorted(f"l{i}" for i in range(21))
    assert [r.title for r in files.synthetic_recipes(spark, 3, {"a": ["x", "y"], "b": ["1", "2"]}).orderBy("i").collect()] == ["x1", "y1", "x2"]


def test_pages(spark):
    xml = '<urlset xmlns:a="b"><url><loc> https://x/1 </loc></url><a:loc>https://x/2</a:loc></urlset>'
    got = pages.sitemap_urls(spark.createDataFrame([(1, xml), (2, "<bad")], "page_id long, xml string"))
    assert [r.url for r in got.orderBy("pos").collect()] == ["https://x/1", "https://x/2"]
    html = """<a href="/recipe/12/">x</a><a href='/recipe/12/'>y</a><a href="/about">z</a><a class="next" href="?p=2">n</a>
      <script type="application/ld+json">{bad</script><script type="application/ld+json">[{"@type":"Thing"},{"@type":"Recipe","name":"n"}]</script>
      <div class="title">T <b>b<p>c</div><script class="title">no</script>"""
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    r = df.select(pages.recipe_links(F.col("html")).alias("l"), pages.has_next(F.col("html")).alias("n"), F.variant_get(pages.linked_data_recipe(F.col("html")), "$.name", "string").alias("name")).first()
    assert (r.l, r.n, r.name) == (["/recipe/12/"], True, "n")
    assert pages.fields_by_class(df, {"title": "title"}).first().text == "T bc"
    u = spark.createDataFrame([("https://a.example/auth/x",), ("https://b.example/y",)], "u string")
    assert [tuple(x) for x in u.select(pages.is_blocked(F.col("u")), pages.on_sites(F.col("u"), ["b.example"])).collect()] == [(True, False), (False, True)]


def test_streams(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(data).selectExpr("CAST(user_id AS STRING) AS client", "CAST(ts AS TIMESTAMP) AS ts")
    q = events.requests_per_window(stream, 2, 3600).writeStream.outputMode("complete").format("memory").queryName("limits").start()
    q.processAllAvailable()
    q.stop()
    want = spark.read.parquet(f"{data}/events.parquet").groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "1 hour")).count()
    assert spark.table("limits").agg(F.sum("n")).first()[0] == want.agg(F.sum("count")).first()[0] and spark.table("limits").count() == want.count()
    fb = spark.readStream.schema(spark.read.parquet(f"{data}/user_feedback.parquet").schema).option("pathGlobFilter", "user_feedback.parquet").parquet(data).withColumn("created_at", F.col("created_at").cast("timestamp"))
    q = events.first_feedback(fb, "3650 days").writeStream.format("memory").queryName("firsts").start()
    q.processAllAvailable()
    q.stop()
    from stockpot.operators.feedback import normal_action

    keys = spark.read.parquet(f"{data}/user_feedback.parquet").select("recipe_id", "client_fingerprint", normal_action().alias("a")).distinct()
    assert spark.table("firsts").count() == keys.count()


def test_stream_ingest(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, '{"schema_version":1,"recipe":{"title":"a"}}'), (2, "bad")], "envelope_id long, body string").write.parquet(src)
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema("envelope_id long, body string").parquet(src)
        events.ingest_envelopes(stream, str(tmp_path / "cp"), str(tmp_path / "ok"), str(tmp_path / "no")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 1 and spark.read.parquet(str(tmp_path / "no")).first().reason == "unreadable"


def test_state_has_a_bound(spark, tmp_path):
    import pytest

    from stockpot.sources import files

    files.save_state(spark, str(tmp_path / "s"), {str(i): "x" for i in range(5)})
    assert len(files.load_state(spark, str(tmp_path / "s"))) == 5 and files.load_state(spark, str(tmp_path / "none")) == {}
    with pytest.raises(ValueError):
        files.load_state(spark, str(tmp_path / "s"), most=4)


def test_lists_of_addresses_may_be_gzipped(spark, tmp_path):
    import gzip

    from stockpot.sources.pages import read_sitemaps, sitemap_urls

    xml = "<urlset><url><loc> https://a.example/recipe/1/ </loc></url></urlset>"
    (tmp_path / "1.xml.gz").write_bytes(gzip.compress(xml.encode()))
    (tmp_path / "2.xml").write_text(xml.replace("1/", "2/"))
    got = sitemap_urls(read_sitemaps(spark, str(tmp_path))).collect()
    assert sorted(r.url for r in got) == ["https://a.example/recipe/1/", "https://a.example/recipe/2/"]


def test_fields_by_layout_or_linked_data(spark):
    import json

    from stockpot.sources.pages import page_fields

    data = {"@type": "Recipe", "name": "L", "recipeIngredient": ["a", " b  c "], "recipeInstructions": "1.cut,2.fry"}
    script = f'<script type="application/ld+json">{json.dumps([{"@type": "Person"}, data])}</script>'
    pages = [(1, '<h1 class="t">Desk <b>top</b></h1><p class="m-t">no</p>' + script), (2, '<p class="m-t">Mobile</p>'), (3, "<p>nothing</p>" + script), (4, None), (5, "<script type='application/ld+json'>{broken</script>")]
    df = spark.createDataFrame(pages, "page_id long, html string")
    got = sorted(tuple(r) for r in page_fields(df, [{"t": "title"}, {"m-t": "title"}]).collect())
    rest = [("ingredient", 0, "a"), ("ingredient", 1, "b c"), ("step", 0, "cut"), ("step", 1, "fry")]
    assert got == sorted([(1, "title", 0, "Desk top"), (2, "title", 0, "Mobile"), (3, "title", 0, "L")] + [(p, *r) for p in (1, 3) for r in rest])
