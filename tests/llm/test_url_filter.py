from grainline.llm.url_filter import judge_urls

COLS = "page_id long, url string, html string, key string, own int"


def judge(spark, rows, **more):
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, (u, h) in enumerate(rows)], COLS)
    return {r["page_id"]: r.asDict() for r in judge_urls(df, **more).collect()}


def test_hosts_paths_and_rules(spark):
    got = judge(spark, [
        ("http://A.Example.COM/en/x?q#f", None), ("https://www.example.com/en/", "x"), ("http://example.com/fr/", ""),
        ("ftp://b.net/es/1", None), ("http://net/fr/", None), ("http://example.com", None), (None, None), ("no scheme.com/en/", None),
        ("http://notnet/es/", None), ("x://a://b/c", None), ("http://ÄB.org?x/y", None), ("", None),
    ])
    want = [
        ("a.example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("example.com", "/fr/", "com/", "allow"), ("b.net", "/es/1", "net/es/", "block"), ("net", "/fr/", "net/fr/", "block"),
        ("example.com", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("notnet", "/es/", None, "allow"),
        ("a:", "//b/c", None, "allow"), ("Äb.org", "", None, "allow"), ("", "", None, "allow"),
    ]
    assert [tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) for i in range(len(want))] == want


def test_blocks_reach_aliases_and_allow_comes_first(spark):
    canon = '<html><LINK href="{}" rel=\'canonical\'></html>'
    refresh = '<meta http-equiv=Refresh content="0; URL={}">'
    got = judge(spark, [
        ("http://a.org/1", canon.format("http://example.com/en/x")),  # to a blocked target that is no page
        ("http://b.org/1", refresh.format("//a.org/1")),  # through another page
        ("http://c.org/1#top", None), ("https://c.org/1?utm_source=f", canon.format("http://b.org/1")),  # one resource
        ("http://d.org/", canon.format("http://x.net/es/1")), ("http://www.example.com/en/ok", canon.format("http://d.org/")),
        ("http://e.org/", "<!-- " + canon.format("http://x.net/es/1") + " -->"), ("http://f.org/a/b", canon.format("../c")),
        ("http://x.net/fr/", canon.format("http://g.org/")), ("http://g.org/", None),
    ])
    assert {i for i, r in got.items() if r["verdict"] == "block"} == {0, 1, 2, 3, 8, 9}
    assert got[5]["rule"] == "www.example.com/en/" and got[4]["verdict"] == "allow"
    assert [got[i]["by_alias"] for i in (0, 8, 9)] == [True, False, True]


def test_hub_chain_repeated_rows_and_empty(spark):
    rows = [("http://hub.net/es/", None)] + [(f"http://p{i}.org/", '<link rel=canonical href="http://hub.net/es/">') for i in range(60)]
    chain = [(f"http://c{i}.org/", f'<link rel="canonical" href="http://c{i + 1}.org/">') for i in range(20)] + [("http://c20.org/", '<link rel=canonical href=http://p3.org/>')]
    got = judge(spark, rows + chain + rows[:3])
    assert len(got) == 61 + 21 + 3 and all(r["verdict"] == "block" for r in got.values())
    assert judge(spark, []) == {}
    assert judge(spark, rows[:1], rules=())[0]["verdict"] == "allow"
