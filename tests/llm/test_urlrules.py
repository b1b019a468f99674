from itertools import combinations

from skein.llm import urlrules
from skein.llm.queries import URL_RULES


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    cut = min((path.index(c) for c in "?#" if c in path), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:cut]


def rule_of(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


ODD = [(-1, None), (-2, "nourl"), (-3, "HTTP://EXAMPLE.org"), (-4, "x://a.b?q/"), (-5, "http://Example.ORG/en/12?x#y"), (-6, "http://a://b.com/de/"), (-7, ""), (-8, "://"), (-9, "http://xorg/"), (-9, "http://İ.org/\nx"), (-10, "http://../a")]


def test_against_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame(ODD, "page_id long, url string"))
    rows = urlrules.judge(pages, URL_RULES).collect()
    assert len(rows) == pages.count()
    seen = {}
    for r in rows:
        host, path = parse(r.url)
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if rule:
            assert r.verdict == verdict
        seen[r.url] = r
    # Mined verdicts: confidence and support of the deciding tokens among the labelled URLs, by counting.
    tokens = {r.url: set(r.tokens) for r in pages.select("url", urlrules.tokens_of(urlrules.host_of(pages["url"]), urlrules.path_of(pages["url"])).alias("tokens")).collect()}
    labelled = [(tokens[r.url], r.verdict) for r in rows if r.rule and tokens[r.url]]
    for r in rows:
        if r.rule is None:
            if r.mined:
                want = set(r.mined.split(" "))
                hit = [v for t, v in labelled if want <= t]
                assert want <= tokens[r.url] and hit.count(r.verdict) / len(hit) >= urlrules.MIN_CONFIDENCE and hit.count(r.verdict) >= urlrules.MIN_SUPPORT * len(labelled)
            else:
                # No combination of up to three of its tokens implies a verdict.
                assert r.verdict == urlrules.DEFAULT
                for n in (1, 2, 3):
                    for part in combinations(sorted(tokens[r.url]), n):
                        hit = [v for t, v in labelled if set(part) <= t]
                        for v in ("allow", "block"):
                            assert hit.count(v) < urlrules.MIN_SUPPORT * len(labelled) or hit.count(v) / len(hit) < urlrules.MIN_CONFIDENCE


def test_plan_is_native(spark, sf):
    plan = urlrules.judge(spark.read.parquet(f"{sf}/pages.parquet"), URL_RULES)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_without_labels(spark):
    pages = spark.createDataFrame(ODD, "page_id long, url string")
    assert {r.verdict for r in urlrules.judge(pages, []).collect()} == {"allow"}
    assert urlrules.judge(pages.limit(0), URL_RULES).count() == 0
    learned = spark.createDataFrame([("http://bad.com/x", "block")] * 3 + [("http://good.com/x", "allow")] * 3, "url string, verdict string")
    got = urlrules.judge(spark.createDataFrame([(1, "http://a.bad.com/y"), (2, "http://good.com/")], "page_id long, url string"), [], learned, min_support=0.1)
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "block", 2: "allow"}


def test_query_against_labels(spark, sf):
    """The registered query: contract columns by hand, and mined rules by counting among the labelled pages."""
    import duckdb
    from skein.llm.queries import OP8_SQL, judged_pages, op8_urls

    pages, labels = spark.read.parquet(f"{sf}/pages.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    url = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    tokens = {r.page_id: set(r.tokens) for r in pages.select("page_id", urlrules.tokens_of(urlrules.host_of(pages["url"]), urlrules.path_of(pages["url"])).alias("tokens")).collect()}
    labelled = [(tokens[r.doc_id], "block" if r.quality == 0 or r.toxic == 1 else "allow") for r in labels.collect() if r.doc_id in url]
    rows = judged_pages(spark, sf).collect()
    assert len(rows) == len(url)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert sorted(map(tuple, op8_urls(spark, sf).collect()), key=str) == sorted(db.sql(OP8_SQL).fetchall(), key=str)
    for r in rows:
        host, path = parse(url[r.page_id])
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        if rule:
            assert r.verdict == verdict and r.mined is None
        elif r.mined:
            hit = [v for t, v in labelled if set(r.mined.split(" ")) <= t]
            assert hit.count(r.verdict) >= max(20, urlrules.MIN_CONFIDENCE * len(hit))
        else:
            assert r.verdict == urlrules.DEFAULT


def test_long_urls_and_clashing_names(spark):
    """Hundreds of segments that come together are one item; columns with names of results stay."""
    long = "http://long.example.com/" + "/".join(f"s{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    rows = [(i, long, "kept") for i in range(30)] + [(100 + i, f"http://h{i}.example.net/p{i}", "kept") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    learned = spark.createDataFrame([(long, "block")] * 30 + [(u, "allow") for _, u, _ in rows[30:]], "url string, verdict string")
    got = urlrules.judge(pages, [], learned, min_count=20, sigmas=2.576)
    assert got.columns == ["page_id", "url", "verdict", "host", "path", "rule", "verdict_", "mined"]
    for r in got.collect():
        assert r.verdict == "kept" and r.verdict_ == ("block" if r.page_id < 100 else "allow")
    only = urlrules.judge(spark.createDataFrame([(1, "https://long.example.com/x"), (2, "http://other.example.com/saa/y")], "page_id long, url string"), [], learned)
    assert {r.page_id: r.verdict for r in only.collect()} == {1: "block", 2: "block"}


def test_many_overlapping_tokens(spark):
    """Baskets of far more tokens than one can have subsets of are mined in bounded time."""
    import random

    draw = random.Random(1)
    rows = [(f"http://h.example.com/{'/'.join(chr(97 + x // 26) + chr(97 + x % 26) for x in draw.sample(range(120), 60))}" + ("/bad/worse" if i % 2 else ""), "block" if i % 2 else "allow") for i in range(120)]
    learned = spark.createDataFrame(rows, "url string, verdict string")
    got = urlrules.judge(spark.createDataFrame([(1, "http://z.example.com/bad/worse")], "page_id long, url string"), [], learned, min_count=20, sigmas=2.576)
    assert got.first().verdict == "block"


def test_rules_beyond_the_model(spark, monkeypatch):
    """Rules of many tokens of a URL, and more rules than literal maps hold, decide as well."""
    rows = [(f"http://h{i}.example.com/" + "/".join(f"t{chr(97 + j)}" for j in range(20) if i >> (j % 4) & 1 or j > 3 and (i * 7 + j * 5) % 11 < 6) + f"/a{chr(97 + i % 26)}", "block" if i % 3 else "allow") for i in range(90)]
    # A rule for each of 250 segments, seen two times.
    rows += [(f"http://x.example.net/only{chr(97 + k // 26)}{chr(97 + k % 26)}/{n}", "block" if k % 2 else "allow") for k in range(250) for n in ("m", "n")]
    pages = spark.createDataFrame([(k, f"http://y.example.net/only{chr(97 + k // 26)}{chr(97 + k % 26)}") for k in range(250)], "page_id long, url string")
    learned = spark.createDataFrame(rows, "url string, verdict string")
    got = {r.page_id: r for r in urlrules.judge(pages, [], learned, min_support=0.0, min_count=2).collect()}
    assert all(got[k].verdict == ("block" if k % 2 else "allow") and f"path:only{chr(97 + k // 26)}{chr(97 + k % 26)}" in got[k].mined for k in range(250))
    some = pages.where("page_id < 40")
    few = learned.where("url LIKE '%/onlya%'")
    want = sorted(map(tuple, urlrules.judge(some, [], few, min_support=0.0, min_count=2).collect()))
    monkeypatch.setattr(urlrules, "ITEMS", 3)
    monkeypatch.setattr(urlrules, "RULES", 5)
    assert sorted(map(tuple, urlrules.judge(some, [], few, min_support=0.0, min_count=2).collect())) == want


def test_all_rules_by_counting(spark):
    """The rules are those of all combinations that no shorter one implies as well."""
    import random

    draw, names = random.Random(4), [f"t{chr(97 + k)}" for k in range(8)]
    rows = [(draw.sample(names, draw.randint(1, 7)), draw.choice(["allow", "block", "block"])) for _ in range(60)]
    model, item = urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), min_support=0.05, min_confidence=0.75)
    token = {i: t for t, i in item.items()}
    got = {(tuple(sorted(token[i] for i in r["items"])), r.verdict, round(r.confidence, 9)) for r in model.collect()}
    share = {}
    for n in range(1, 9):
        for part in combinations(names, n):
            hit = [v for t, v in rows if set(part) <= set(t)]
            for v in ("allow", "block"):
                if hit.count(v) >= 3 and hit.count(v) / len(hit) >= 0.75:
                    share[part, v] = hit.count(v) / len(hit)
    want = {(p, v, round(c, 9)) for (p, v), c in share.items() if not any(set(q) < set(p) and w == v and d >= c for (q, w), d in share.items())}
    assert got == want and max(len(p) for p, _, _ in want) > 2
