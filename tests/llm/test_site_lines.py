from collections import Counter

from pyspark.sql import functions as F

from askgauge.llm import site_lines

KIND = "page_id long, url string, html string, host string, row string, page string, lines string, kept string"


def run(spark, rows):
    df = spark.createDataFrame([(k, u, h, "a", "b", "c", "d", "e") for k, u, h in rows], KIND)
    return site_lines.drop_site_lines(df, site_lines.html_lines(F.col("html")), site_lines.host_of(F.col("url")))


def brute(rows, ratio=0.5, least=2):
    pages = [(k, (u or "").split("://")[-1].split("/")[0].split("@")[-1].split(":")[0].lower(), [x.strip(" ") for x in (h or "").split("<br>") if x.strip(" ")]) for k, u, h in rows]
    total = Counter(host for _, host, _ in pages)
    seen = Counter((host, line) for _, host, lines in pages for line in set(lines))
    bad = {key for key, n in seen.items() if n > 1 and total[key[0]] >= least and n > ratio * total[key[0]]}
    return Counter((k, host, tuple(x for x in lines if (host, x) not in bad)) for k, host, lines in pages)


def test_lines_of_most_pages_of_a_host_go(spark):
    rows = [(i, f"https://me@A.org:80/{i}", f"menu<br>{'half' if i < 5 else 'x'}<br>own {i}<br>own {i}<br>menu") for i in range(10)]
    rows += [(20, "http://b.org/1", "menu"), (21, "http://b.org/2", "menu"), (None, None, None), (22, "no url", ""), (0, "https://me@A.org:80/0", rows[0][2]), (30, "http://a.org", "z" * 100_000 + "<br>menu")]
    got = Counter((r["page_id"], r["host"] if r["page_id"] != 22 else "no url", tuple(r["kept"])) for r in run(spark, rows).collect())
    assert got == brute(rows)


def test_urls_without_a_scheme_have_hosts(spark):
    urls = {"example.com/x": "example.com", "//Example.com:8/x": "example.com", "www.é.org?q": "www.é.org", "a.org:80": "a.org", "mailto:me@a.org": "", "../a.html": "", "no url": "", "http://me@b.org/a.b": "b.org", "": ""}
    rows = [(i, url, "") for i, url in enumerate(urls)]
    assert [r["host"] for r in run(spark, rows).orderBy("page_id").collect()] == list(urls.values())
    # Boilerplate of one site is not thinned out by the pages of others.
    rows = [(i, f"a.org/{i}", f"menu<br>{i}") for i in range(4)] + [(10 + i, f"b{i}.org/x", f"own {i}") for i in range(9)]
    assert {tuple(r["kept"]) for r in run(spark, rows).where("host = 'a.org'").collect()} == {(str(i),) for i in range(4)}


def test_empty_table_and_markup(spark):
    assert run(spark, []).count() == 0
    row = run(spark, [(1, "http://x.org", "<p>A <b>b</b><script>t</script><!-- c --><style>s</style>\r\n <li> d")]).first()
    assert row["lines"] == ["A", "b", "d"] == row["kept"]


def test_no_python_in_the_plan(spark, folder):
    plan = site_lines.op3_site_lines(spark, folder)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hosts_of_two_pages(spark):
    rows = [(1, "http://two.org/a", "menu<br>a"), (2, "http://two.org/b", "menu<br>b"), (3, "http://one.org", "menu<br>c")]
    assert {r["page_id"]: tuple(r["kept"]) for r in run(spark, rows).collect()} == {1: ("a",), 2: ("b",), 3: ("menu", "c")}
