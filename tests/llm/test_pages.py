"""URL filter and WARC archives."""

import hashlib
import pathlib

import duckdb
import pytest
from pyspark.sql import functions as F

from puspark.llm import url_filter, warc
from puspark.llm.sql import SQL

PAGES = "page_id long, url string, html string, host string, payload string, rule string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "p", "r") for r in rows], PAGES).repartition(3)


URLS = [
    None, "", "no scheme", "http://", "://x", "http://A.Example.ORG", "http://example.org/es/1", "http://xexample.org/es/1", "https://a.example.org/en/12?q#f",
    "http://example.org/en/2", "http://www.shop.com/fr/a", "http://com/de/x", "http://net.com/de", "http://h.com#/fr/", "http://h.com?x=http://y.org/", "ftp://u@h.org:80/p",
    "http://é.net/ü/" + "s" * 5000, "http://a.net//b//c/", "http://ORG/x",
]


def rule_by_hand(host, path):
    fits = [(rule, verdict) for rule, verdict in url_filter.RULES for name, _, rest in [rule.partition("/")] if (host == name or host.endswith("." + name)) and path.startswith("/" + rest)]
    return max(fits, key=lambda r: len(r[0]), default=None)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    rest = rest[:end]
    at = rest.find("/")
    host, path = (rest, "") if at < 0 else (rest[:at], rest[at:])
    return host.translate({c: c + 32 for c in range(65, 91)}), path


@pytest.fixture(scope="module")
def url_rows():
    rows = [(k, u, "") for k, u in enumerate(URLS)]
    for h in range(6):  # hosts with a wide level, branches that are alike, and labels of both kinds
        for k in range(60):
            rows.append((1000 + 100 * h + k, f"http://h{h}.{'com' if h < 4 else 'net'}/{['fr', 'de', 'en', 'es'][(k + h) % 4]}/{'u' + chr(97 + k % 26) if h % 2 else k}/{k % 3}.html", ""))
    return rows + [(None, "http://h1.com/de/ua/1.html", ""), (5, URLS[8], None), (5, URLS[8], None)]


def test_rules_and_parts(spark, url_rows):
    got = url_filter.judge(pages(spark, url_rows)).collect()
    by_id = {i: u for i, u, _ in url_rows if i is not None and i != 5}
    assert len(got) == len(url_rows)
    for r in got:
        if r["page_id"] in by_id:
            host, path = parts(by_id[r["page_id"]])
            rule = rule_by_hand(host, path)
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0])
            assert r["verdict"] == rule[1] if rule else r["verdict"] in ("allow", "block")


def test_verdicts_are_those_of_the_sql(spark, url_rows):
    got = url_filter.judge(pages(spark, url_rows)).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", url_rows)
    want = con.sql(SQL["op8_urls"])
    columns = want.columns
    assert sorted(str([r[c] for c in columns]) for r in got) == sorted(str(list(r)) for r in want.fetchall())
    assert {r["verdict"] for r in got if r["rule"] is None} == {"allow", "block"}


def test_branches_are_generalised_at_any_depth(spark):
    """60 siblings at level five are one template; similar branches merge at their own level, different ones do not."""
    deep = [["a", "b", "c", "d", f"word{chr(97 + k // 26)}{chr(97 + k % 26)}"] for k in range(60)]
    alike = [["x", lang, kind] for lang in ("ta", "tb") for kind in ("news", "blog") for _ in range(20)]
    apart = [["y", lang, kind] for lang, kind in (("ta", "news"), ("tb", "blog")) for _ in range(40)]
    rows = [("h.net", segments, None) for segments in deep + alike + apart] + [("h.net", [], None)]
    table = spark.createDataFrame(rows, "host string, segments array<string>, label string")
    found = {tuple(r["segments"]): tuple(r["template"]) for r in url_filter.templates(table).collect()}
    assert {found[tuple(s)][1:] for s in deep} == {("b", "c", "d", "*")}
    assert {found[tuple(s)][1:] for s in alike} == {("*", "news"), ("*", "blog")}
    assert {found[tuple(s)][1:] for s in apart} == {("ta", "news"), ("tb", "blog")}
    assert found[()] == ("",)


def test_deep_paths_equal_the_sql(spark):
    import random

    rng = random.Random(8)
    part = lambda: rng.choice(["en", "fr", "news", "blog", "a", "b", f"{rng.randrange(99)}", "w" * rng.randrange(1, 30), chr(97 + rng.randrange(26)) * 2])
    urls = [f"http://{rng.choice(['h.net', 'www.example.org', 'k.com'])}/" + "/".join(part() for _ in range(rng.randrange(8))) for _ in range(600)]
    rows = [(i, u, None) for i, u in enumerate(urls)]
    got = url_filter.judge(pages(spark, rows)).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = con.sql(SQL["op8_urls"])
    columns = want.columns
    assert sorted(str([r[c] for c in columns]) for r in got) == sorted(str(list(r)) for r in want.fetchall())


def test_no_pages(spark, tmp_path):
    assert url_filter.judge(pages(spark, [])).count() == 0
    warc.write(pages(spark, []), f"{tmp_path}/none")
    assert warc.read(spark, f"{tmp_path}/none").count() == 0


BODY = "<p>é\r\n\r\nWARC/1.1\r\nWARC-Type: response</p>" * 40
HTML = [(1, "http://a b/\n?%41é", BODY), (2, None, BODY), (9, "u", BODY), (9, "u", BODY), (3, "u", None), (4, "u", ""), (5, "u", "same but short"), (6, "u", "same but short"), (None, "v", BODY), (None, "v", "only " * 500), (7, "w", "x" * 3_000_000)]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "archive")
    warc.write(pages(spark, HTML), path)
    return path


def test_round_trip(spark, archive):
    got = warc.read(spark, archive).collect()
    assert len(got) == len(HTML)
    found = sorted((r["record_id"] or "", r["target_uri"] or "", r["record_type"], r["refers_to"] or "", r["payload_bytes"]) for r in got)
    want = []
    for i, url, html in HTML:
        revisit = html == BODY and i != 9
        want.append((str(i or ""), url or "", "revisit" if revisit else "response", "9" if revisit else "", len((html or "").encode())))
    assert found == sorted(want)
    for r in got:
        if r["record_type"] == "response":
            assert len(r["payload"]) == r["payload_bytes"] and hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]
        else:
            assert r["payload"] is None and r["payload_digest"] == hashlib.sha1(BODY.encode()).hexdigest()


def test_filters_are_pushed_down(spark, archive):
    table = warc.read(spark, archive)
    only = table.filter((F.col("record_type") == "revisit") & F.col("record_id").isin("1", "9"))
    assert [r["record_id"] for r in only.collect()] == ["1"]
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("BatchScan", "").split("\n")[0] and "isin" not in plan.lower().split("batchscan")[0]
    assert table.filter("record_id is null and target_uri like 'v%'").count() == 2
    assert {r["payload"] for r in warc.read(spark, archive, payload=False).collect()} == {None}


def test_unwanted_payloads_are_skipped(archive):
    class Counting(warc.WarcReader):
        def _records(self, raw):
            self.raw = raw
            return super()._records(raw)

    from pyspark.sql.datasource import EqualTo

    reader = Counting({"path": archive})
    assert list(reader.pushFilters([EqualTo(("record_id",), "7"), EqualTo(("payload",), b"")])) == [EqualTo(("payload",), b"")]
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[1] for r in rows] == ["7"] and len(rows[0][-1]) == 3_000_000


def test_files_are_dealt_out_by_size(archive, tmp_path):
    content = b"".join(f.read_bytes() for f in pathlib.Path(archive).glob("part-*"))
    for k in range(5):
        (tmp_path / f"part-{k}").write_bytes(content)
    (tmp_path / "_SUCCESS").write_bytes(b"x")
    groups = [len(p.paths) for p in warc.WarcReader({"path": str(tmp_path), "partitionBytes": str(2 * len(content))}).partitions()]
    assert groups == [2, 2, 1]
    assert len(warc.WarcReader({"path": str(tmp_path)}).partitions()) == 1
