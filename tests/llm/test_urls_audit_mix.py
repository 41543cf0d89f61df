import random
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest
from llm_samples import SCHEMA

from rasterspark.llm import merkle, mixing, url_templates


def oracle(folder, sql, names):
    con = duckdb.connect()
    for n in names:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet/*.parquet'")
    return con.execute(sql).fetchall()


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    rng = random.Random(7)
    at = tmp_path_factory.mktemp("pages")
    hosts = ["a.example.com", "b.example.com", "x.example.net", "y.example.org", "other.io", "net"]
    rows = [(i, f"http{'s' * (i % 2)}://{rng.choice(hosts)}/{rng.choice(['de', 'en', 'fr', 'blog'])}/{rng.choice(['p', 'q', 'item'])}{rng.randrange(900)}{rng.choice(['', '/', '.html', '?a=/b', '#x'])}", "<p>x</p>" * rng.randrange(5)) for i in range(700)]
    rows += [(700 + i, f"http://slugs.io/{chr(97 + i % 26)}{chr(97 + i // 26)}slug/page", None) for i in range(80)]
    odd = [None, "", "no scheme", "://", "http://", "http://NET/", "http://net", "HTTP://Ü.Example.NET/en/x", "http://a.net?q=://z/de/", "x://example.com/de/1#a", "http://h/" + "/".join("abcdefgh"), "http://h//", "http://sub.example.com/de/\nnext", "a\nb://example.org/fr/1"]
    rows += [(900 + i, u, "y") for i, u in enumerate(odd)]
    spark.createDataFrame([*rows, rows[3]], "page_id long, url string, html string").repartition(3).write.parquet(f"{at}/pages.parquet")
    return str(at)


def test_url_query_equals_sql(spark, pages, empty):
    got = url_templates.op6_url_templates(spark, pages)
    want = oracle(pages, f"SELECT {', '.join(got.columns)} FROM ({url_templates.ORACLE})", ["pages"])
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert url_templates.op6_url_templates(spark, empty).count() == 0


def test_url_rules_and_templates(spark, pages):
    rows = {r.page_id: r for r in url_templates.filter_urls(spark.read.parquet(f"{pages}/pages.parquet").withColumn("host", url_templates.F.lit(1))).collect()}
    assert (rows[900].host, rows[900].path, rows[900].rule) == ("", "", None) and rows[900].verdict == "allow"
    assert (rows[905].host, rows[905].path, rows[905].rule, rows[905].verdict) == ("net", "/", "net/", "block")
    assert (rows[906].path, rows[906].rule) == ("", None)
    assert (rows[907].host, rows[907].rule, rows[907].verdict) == ("Ü.example.net", "example.net/en/", "allow")
    assert (rows[908].host, rows[908].path, rows[908].rule) == ("a.net", "", None)
    assert (rows[909].host, rows[909].path, rows[909].rule) == ("example.com", "/de/1", "example.com/de/")
    assert rows[912].path == "/de/\nnext"
    assert rows[705].template.startswith("/*") and len({rows[700 + i].template for i in range(80)}) == 1


def test_a_blocked_path_leaves_the_rest_of_a_large_host(spark):
    """Labels of one path don't condemn a host's other pages, whatever merges; templates follow paths of any depth."""
    rows = [f"http://blog.example.com/{lang}/{kind}/p{i}" for lang in ("de", "it", "pl", "sv") for kind in ("a", "b") for i in range(40)]
    rows += [f"http://blog.example.com/x/y/z/u{chr(97 + i % 26)}{chr(97 + i // 26)}name/v{chr(97 + i % 7)}/end" for i in range(130)]
    rows += ["http://mostly.example.com/de/" + str(i) for i in range(50)] + ["http://mostly.example.com/it/1"]
    pages = spark.createDataFrame([(u,) for u in rows], "url string")
    out = url_templates.filter_urls(pages).collect()
    for r in out:
        assert (r.verdict == "block") == (r.rule is not None or r.host.startswith("mostly")), r
    assert {r.template for r in out if "/de/" in r.path and r.host.startswith("blog")} == {"/de/~+/p#"}
    assert any(r.template.startswith("/x/y/z/*/") for r in out)


def test_native_plan(spark, pages):
    plan = url_templates.op6_url_templates(spark, pages)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Cartesian", "NestedLoop"))


def test_audit_query_equals_sql(spark, pages, empty):
    clean = spark.read.parquet(f"{pages}/pages.parquet").dropDuplicates(["page_id"])
    at = pages + "-once"
    clean.write.parquet(f"{at}/pages.parquet")
    got = merkle.op4_merkle_audit(spark, at)
    want = oracle(at, f'SELECT archive, "offset", kind, first_hash, second_hash FROM ({merkle.ORACLE})', ["pages"])
    assert Counter(map(tuple, got.select("archive", "offset", "kind", "first_hash", "second_hash").collect())) == Counter(want) and len(want) > 20
    assert merkle.op4_merkle_audit(spark, empty).count() == 0


def test_audit_finds_every_difference(spark):
    rng = random.Random(9)
    first = [("a", 200 * i, f"rec{rng.random()}", 1) for i in range(1200)] + [("b", 0, "only here", 1), ("c", 5, None, 1), (None, 3, "x", 1), ("a", None, "y", 1), ("d", 0, "p", 1), ("d", 0, "q", 1)]
    second = list(first)
    second[17] = ("a", 3400, "broken", 1)
    second[1199] = ("a", 200 * 1199, None, 1)
    second = [r for r in second if r[0] != "b" and r[1] != 4000] + [("a", 10**7, "far", 1)]
    second[second.index(("d", 0, "q", 1))] = ("d", 0, "r", 1)
    second[second.index(("c", 5, None, 1))] = ("c", 5, "", 1)
    make = lambda rows: spark.createDataFrame(rows, "archive string, offset long, payload string, node int")
    found = {(r.archive, r.offset, r.kind) for r in merkle.audit(make(first), make(second), 4096, 4).collect()}
    assert found == {
        ("a", 3400, "changed"), ("a", 200 * 1199, "changed"), ("a", 4000, "missing"), ("a", 10**7, "extra"), ("b", 0, "missing"), ("c", 5, "changed"), ("d", 0, "changed"),
        (None, 3, "unplaced"), ("a", None, "unplaced"),
    }
    assert merkle.audit(make(first), make(first), 4096, 4).where("kind != 'unplaced'").count() == 0


def test_mix_emits_everything_in_order(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("block", mixing.F.lit("own"))
    got = mixing.mix(docs, {"s0": 5, "s1": 2, "s2": 1, None: 2}, block_docs=4).collect()
    first = Counter((r.doc_id, r.text) for r in got if r.epoch == 0)
    assert first == Counter((i, t) for i, t, *_ in rows)
    sources = defaultdict(list)
    by_slot = defaultdict(set)
    for r in got:
        by_slot[r.slot].add((r.source, r.block, r.epoch))
        sources[r.source].append(r)
    assert sorted(by_slot) == list(range(len(by_slot))) and all(len(v) == 1 for v in by_slot.values())
    taken, total = Counter(), 10
    for slot in sorted(by_slot):
        source = next(iter(by_slot[slot]))[0]
        taken[source] += 1
        for s, w in {"s0": 5, "s1": 2, "s2": 1, None: 2}.items():
            assert abs(taken[s] - Fraction(w * (slot + 1), total)) < 1
    for s, rs in sources.items():
        order = [(r.epoch, r.block) for r in sorted(rs, key=lambda r: r.slot)]
        assert order == sorted(order)
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s0": 1})
    assert mixing.stage(spark, docs, folder).columns == docs.columns
    assert mixing.stage(spark, spark.createDataFrame([], SCHEMA), folder).count() == 0


def test_numbering_is_dense_over_ranges(spark, folder, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_DOCS", 5)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    numbers = defaultdict(list)
    for r in mixing.numbered(docs).collect():
        numbers[r.source].append(r["_no"])
    assert all(sorted(v) == list(range(len(v))) for v in numbers.values())
