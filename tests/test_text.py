import pytest
from pyspark.sql import functions as F

from stockpot.functions import text as X
from stockpot.operators.search import hash_embeddings


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f("t").alias("o")).first()["o"]


@pytest.mark.parametrize(
    "text, want",
    [("土豆鸡蛋", ["土豆", "豆鸡", "鸡蛋"]), ("abc 123", ["abc", "123"]), ("椒", ["椒"]), ("", []), (None, []), ("X椒y", ["椒", "x", "y"])],
)
def test_tokens(spark, text, want):
    assert one(spark, text, X.tokens) == want


def test_clean(spark):
    assert one(spark, "土豆\0 炒\x1f鸡蛋　 ", X.clean_text) == "土豆 炒鸡蛋"
    assert one(spark, "\xa0a \t b\n", X.clean_text) == "a b"
    assert one(spark, None, X.clean_text) == ""
    assert one(spark, " 第一行 \r\n\r\n　第二行\r", X.clean_lines) == "第一行\n第二行"
    assert one(spark, "<p>a<script>x</script>b<br>c</p>", X.strip_markup) == "a b c"


def test_splits(spark):
    assert one(spark, "1.先切菜,2.下锅炒", X.split_instructions) == ["先切菜", "下锅炒"]
    assert one(spark, " 1、切  2. 3．炒 4 个, ，5.装盘", X.split_instructions) == ["切", "炒 4 个", "装盘"]
    assert one(spark, "", X.split_instructions) == []
    got = one(spark, "两个土豆、三颗鸡蛋和一斤牛肉，半斤虾", X.split_items)
    assert [(r["name"], r["quantity"]) for r in got] == [("土豆", "两个"), ("鸡蛋", "三颗"), ("牛肉", "一斤"), ("虾", "半斤")]
    assert one(spark, " a, ,b ", X.csv_values) == ["a", "b"]


def test_urls(spark):
    assert one(spark, "https://a.example/recipe/1/?from=app#x", X.normal_url) == "https://a.example/recipe/1/"
    assert one(spark, "https://U@A.example:80/x", X.url_host) == "a.example"
    assert one(spark, "nothing", X.normal_url) is None


def test_client_address(spark):
    rows = [("1.2.3.4, 10.0.0.9", "10.0.0.1", "1.2.3.4"), (None, "10.0.0.1", "10.0.0.1"), ("bad", "10.0.0.1", "10.0.0.1"), ("10.0.0.2", "10.0.0.1", "10.0.0.1"), ("1.2.3.4", "9.9.9.9", "9.9.9.9")]
    df = spark.createDataFrame(rows, "f string, d string, want string")
    assert df.select(X.client_address(F.col("f"), F.col("d"), ["10.0.0.0/8"]).alias("o"), "want").where("o <> want").count() == 0


def test_networks(spark):
    import ipaddress

    nets = ["10.0.0.0/8", "192.168.4.0/22", "fd00::/8", "2001:db8::1", "0.0.0.0/32"]
    addresses = ["10.1.2.3", "192.168.7.255", "192.168.8.0", "fd12::", "FD00:0:0::1", "2001:db8:0:0:0:0:0:1", "2001:db8::2", "::", "::1", "1::2::3", "300.1.1.1", "1.2.3", "", "x", None, "1:2:3:4:5:6:7:8", "0.0.0.0"]
    df = spark.createDataFrame([(a,) for a in addresses], "a string")
    rows = df.select("a", X.in_networks(F.col("a"), nets).alias("i"), X.address_bits(F.col("a")).alias("b")).collect()
    for r in rows:
        try:
            ip = ipaddress.ip_address(r.a)
        except ValueError:
            assert r.b is None and not r.i
            continue
        assert r.b == format(int(ip), f"0{ip.max_prefixlen}b") and r.i == any(ip in ipaddress.ip_network(n) for n in nets)


def test_addresses_of_pages(spark):
    base = "https://www.a.example/x/y?z#q"
    cases = {"/r/1?p": "https://www.a.example/r/1?p", "//b.example/r": "https://b.example/r", "http://c.example/": "http://c.example/", "r/1": None, "": None, None: None}
    df = spark.createDataFrame([(h, base) for h in cases], "h string, b string")
    assert {r.h: r.o for r in df.select("h", X.absolute_url("h", "b").alias("o")).collect()} == cases
    got = {r.h: r.o for r in df.select("h", X.canonical_url("h", "b", ["www.a.example"]).alias("o")).collect()}
    assert got["/r/1?p"] == "https://www.a.example/r/1" and got["//b.example/r"] == got[None] == "https://www.a.example/x/y"
    assert df.select(X.canonical_url("h", "b", ["z.example"]).alias("o")).where("o is not null").count() == 0


def test_sets_and_hashes(spark):
    df = spark.createDataFrame([([" b", "a", "a", ""],), (None,)], "v array<string>")
    assert [r[0] for r in df.select(X.canonical_set(F.col("v"))).collect()] == [["a", "b"], []]
    docs = spark.createDataFrame([(1, "abc abc x"), (2, "")], "doc_id long, text string")
    v = hash_embeddings(docs, 64).collect()
    assert abs(sum(r["value"] ** 2 for r in v) - 1) < 1e-9 and {r["doc_id"] for r in v} == {1}
