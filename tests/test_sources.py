import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.catalog.payloads import inverted
from tidemark.operators.quality import validate_snapshot
from tidemark.plans.scan import BoilerplateError, run_backfill, run_scan
from tidemark.operators.select import SelectConfig
from tidemark.rules import RuleSet
from tidemark.sources import feeds, markdown, registry, snapshots
from tidemark.sources.records import RECORD_COLUMNS

from .helpers import now, record, records
from .test_match_score import RULES


def clock():
    return F.lit("2026-07-28 12:00:00").cast("timestamp")



def payloads(spark, bodies, **extra):
    rows = [(i, b if isinstance(b, str) else json.dumps(b), *[v[i] if isinstance(v, list) else v for v in extra.values()]) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, ", ".join(["payload_no bigint", "payload string", *[f"{k} string" for k in extra]]))


def test_rss(spark):
    body = """<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><lastBuildDate>Mon, 27 Jul 2026 00:00:00 -0400</lastBuildDate>
    <item><title>Paper   one</title><link>https://arxiv.org/abs/2607.11111</link>
      <description>arXiv:2607.11111v2 Announce Type: replace-cross
      Abstract: Some   text.</description><dc:creator>Ada L, Bob and Eve</dc:creator><category>cs.CV</category><category>cs.CL</category></item>
    <item><title>Two</title><link>https://example.org/x</link><description>no marker</description><pubDate>28 Jul 2026 01:00:00 GMT</pubDate></item>
    <item><title></title><link>https://example.org/y</link></item></channel></rss>"""
    one, two = feeds.rss_records(payloads(spark, [body], feed="cs.CV"), clock()).orderBy("position").collect()
    assert one["source_id"] == "2607.11111" and one["title"] == "Paper one" and one["event_kind"] == "updated"
    assert one["summary"] == "Some text." and one["authors"] == ["Ada L", "Bob", "Eve"]
    assert one["published_at"] == datetime(2026, 7, 27, 4) and one["artifact_urls"] == ["https://arxiv.org/pdf/2607.11111"]
    assert one["facets"]["arxiv_categories"] == ["cs.CV", "cs.CL"] and one["facets"]["feed"] == ["cs.CV"]
    assert two["source_id"] == "https://example.org/x" and two["published_at"] == datetime(2026, 7, 28, 1) and two["event_kind"] == "published"
    assert list(one.asDict()) == list(RECORD_COLUMNS)


def test_atom(spark):
    body = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2607.22222v1</id>
    <title>T</title><published>2026-07-01T00:00:00Z</published><updated>2026-07-02T00:00:00Z</updated><summary> S </summary>
    <author><name>Ada</name></author><author><name>Bob</name></author><link href="http://arxiv.org/pdf/2607.22222v1" title="pdf"/><link href="x"/>
    <arxiv:primary_category term="cs.CV"/><category term="cs.CV"/></entry></feed>"""
    (row,) = feeds.atom_records(payloads(spark, [body]), clock()).collect()
    assert row["event_kind"] == "updated" and row["authors"] == ["Ada", "Bob"] and row["artifact_urls"] == ["http://arxiv.org/pdf/2607.22222v1"]
    assert row["facets"]["primary_category"] == ["cs.CV"] and row["updated_at"] == datetime(2026, 7, 2)


def test_hub_cards_only_for_freshest(spark):
    repo = lambda i, day, **x: {"id": f"own/m{i}", "createdAt": f"2026-07-{day}T00:00:00.000Z", "lastModified": f"2026-07-{day}T00:00:00.000Z", **x}
    bodies = [
        [repo(1, 27, downloads=0, likes=5, tags=["a", "b"], pipeline_tag="vqa", cardData={"license": "mit", "task_categories": ["x", "y"]}), repo(2, 10)],
        [repo(1, 27, likes=99), repo(3, 28)],
    ]
    cards = spark.createDataFrame([(f"own/m{i}", f"Card prose number {i} which is certainly long enough to stay.") for i in (1, 2, 3)], "repo_id string, body string")
    got = {r["source_id"]: r for r in feeds.hub_records(payloads(spark, bodies, query=["q1", "q2"]), clock(), "models", cards, card_limit=2).collect()}
    assert set(got) == {"own/m1", "own/m2", "own/m3"}
    assert got["own/m1"]["metrics"] == {"likes": 5.0} and got["own/m1"]["organizations"] == ["own"]
    assert got["own/m1"]["facets"] == {"tags": ["a", "b"], "query": ["q1"], "hub_kind": ["models"], "pipeline_tag": ["vqa"], "license": ["mit"], "task_categories": ["x", "y"]}
    assert [got[f"own/m{i}"]["summary"] != "" for i in (1, 2, 3)] == [True, False, True]
    assert got["own/m1"]["event_kind"] == "published" and got["own/m2"]["event_kind"] == "updated"


def test_papers(spark):
    bodies = [
        [{"paper": {"id": "2607.1", "title": " A  b ", "summary": "s", "authors": [{"name": "Ada"}, {"fullname": "Bob"}, "Eve"], "upvotes": 3}, "publishedAt": "2026-07-27", "numComments": 2}],
        [{"id": "2607.1", "title": "later"}, {"id": "2607.2", "title": "flat", "publishedAt": "2026-07-26"}],
    ]
    one, two = feeds.paper_records(payloads(spark, bodies, listed_on=["2026-07-28", "2026-07-27"]), clock()).orderBy("position").collect()
    assert one["title"] == "A b" and one["authors"] == ["Ada", "Bob", "Eve"] and one["metrics"] == {"upvotes": 3.0, "comments": 2.0}
    assert one["facets"] == {"listed_on": ["2026-07-28"]} and one["published_at"] == datetime(2026, 7, 27) and two["source_id"] == "2607.2"


def test_repos_and_releases(spark):
    repo = {"full_name": "o/r", "html_url": "https://github.com/o/r", "description": "d " * 500, "homepage": "https://h", "stargazers_count": 7, "forks_count": 0,
            "created_at": "2026-07-28T00:00:00Z", "pushed_at": "2026-07-28T01:00:00Z", "owner": {"login": "O"}, "topics": ["t"], "language": "Python", "license": {"spdx_id": "MIT"}}
    (row,) = feeds.repo_records(payloads(spark, [{"items": [repo, {"full_name": "x/y"}]}], query="q"), clock()).collect()
    assert row["metrics"] == {"stars": 7.0} and row["artifact_urls"] == ["https://github.com/o/r", "https://h"] and row["organizations"] == ["O"]
    assert len(row["summary"]) == 999 and row["facets"]["license"] == ["MIT"] and row["event_kind"] == "published"
    release = lambda **x: {"tag_name": "v1", "name": "", "html_url": "https://g/r", "published_at": "2026-07-28T00:00:00Z", "body": "b", **x}
    bodies = [[release(), release(tag_name="v2", draft=True), release(tag_name="v0", published_at="2026-07-01T00:00:00Z"), release(tag_name="")]]
    (rel,) = feeds.release_records(payloads(spark, bodies, repo="o/r"), clock()).collect()
    assert rel["source_id"] == "o/r@v1" and rel["title"] == "o/r v1" and rel["event_kind"] == "released" and rel["facets"]["prerelease"] == ["false"]


def test_scholar_and_works(spark):
    papers = {"data": [
        {"paperId": "p1", "title": "T", "year": 2025, "externalIds": {"ArXiv": "2501.1", "DOI": "10.1/x"}, "citationCount": 4, "authors": [{"name": "Ada"}], "venue": " V  w "},
        {"title": "No id", "url": "https://s/1", "publicationDate": "2026-07-01"}, {"title": "No url"}, {"paperId": "p1", "title": "again", "url": "z"},
    ]}
    rows = {r["source_id"]: r for r in feeds.scholar_records(payloads(spark, [papers], query="q"), clock()).collect()}
    assert set(rows) == {"p1", "No id"} and rows["p1"]["url"] == "https://arxiv.org/abs/2501.1" and rows["p1"]["published_at"] == datetime(2025, 1, 1)
    assert rows["p1"]["facets"]["doi"] == ["10.1/x"] and rows["p1"]["venue"] == "V w" and rows["p1"]["metrics"] == {"citations": 4.0}
    works = {"results": [{"id": "https://openalex.org/W9", "display_name": "W", "doi": "https://doi.org/10.1/y", "publication_date": "2026-07-02",
             "abstract_inverted_index": {"world": [1, 3], "hello": [0], "again": [2]}, "primary_location": {"source": {"display_name": "J"}, "pdf_url": "http://pdf"},
             "authorships": [{"author": {"display_name": "Ada"}, "institutions": [{"display_name": "U"}, {"display_name": "U"}]}, {"author": {"display_name": "Bob"}}]}]}
    (work,) = feeds.works_records(payloads(spark, [works], query="q"), clock()).collect()
    assert work["summary"] == "hello world again world" and work["source_id"] == "W9" and work["organizations"] == ["U"] and work["authors"] == ["Ada", "Bob"]
    assert work["artifact_urls"] == ["https://doi.org/10.1/y", "http://pdf"] and work["venue"] == "J"


DOC = """# Repository title
intro | not a table
## 1. SoTA models
| Name (Org) | Release Date | Size | Paper |
|---|:---:|---|---|
| **[Alpha](https://a.org/x)** (Maker Lab) | 07/21/2026 | 7B | [paper](https://p.org/1) [code](https://c.org/1) |
| Beta | 2026-07-01 | - | [paper](https://p.org/2) |
| No link row | 2026 | 1B | none |
| [Alpha](https://a.org/x) (Maker Lab) | 2020 | 7B | dup |

```
| Fenced | Link |
|---|---|
| [F](https://f.org) | x |
```
## 2. Robotics
### 2.1 Manipulation \U0001f916
#### Deep
| Model | Link |
| --- | --- |
| Gamma | <a href="x">t</a> [site](https://g.org) |
## 3. Empty
| A | B |
| - | - |
### Back
| Delta | [d](https://d.org) |
| Model | Year |
|---|---|
| [Eps](https://e.org) | soon |
"""
HEADINGS = RuleSet.from_config({"heading_categories": {"SoTA": ["vlm_model"], "robotics": ["embodied"], "manipulation": ["embodied", "arm"]}})


def test_markdown_tables(spark):
    docs = spark.createDataFrame([("report/2026-07-20", "2026-07-20", DOC)], "origin string, report_date string, text string")
    rows = markdown.markdown_table_records(docs, HEADINGS, clock()).orderBy("position").collect()
    assert [r["title"] for r in rows] == ["Alpha", "Beta", "Gamma", "Eps"]
    alpha, beta, gamma, eps = rows
    assert alpha["url"] == "https://a.org/x" and alpha["organizations"] == ["Maker Lab"] and alpha["published_at"] == datetime(2026, 7, 21)
    assert alpha["artifact_urls"] == ["https://p.org/1", "https://c.org/1"] and alpha["summary"] == "Size: 7B. Paper: paper code"
    assert alpha["hint_categories"] == ["vlm_model"] and alpha["section"] == "1. SoTA models" and alpha["provenance"] == "curated"
    assert alpha["source_id"] == "report/2026-07-20:alpha:https-a-org-x"
    assert beta["url"] == "https://p.org/2" and beta["summary"] == ""
    assert gamma["section"] == "2. Robotics > 2.1 Manipulation > Deep" and gamma["hint_categories"] == ["embodied", "arm"]
    assert gamma["published_at"] == datetime(2026, 7, 20)
    assert eps["section"] == "3. Empty > Back" and eps["published_at"] == datetime(2026, 7, 20)


def test_files_name_their_report_date(spark, tmp_path):
    (tmp_path / "progress 2026-05-02.md").write_text(DOC)
    (tmp_path / "undated.md").write_text(DOC)
    files = spark.read.text(str(tmp_path), wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    docs = markdown.files_to_documents(files).collect()
    assert [(d["origin"], d["report_date"]) for d in docs] == [("report/2026-05-02", "2026-05-02")]


def test_bad_source_costs_only_its_rows(spark):
    good = records(spark, [record(0), record(1)])
    sources = {"a": good, "bad": lambda: spark.read.parquet("/no/such/path"), "b": good.limit(1)}
    rows, health = registry.collect_sources(spark, sources, required=("bad",))
    status = {r["source_key"]: (r["ok"], r["item_count"]) for r in health.collect()}
    assert status == {"a": (True, 2), "bad": (False, 0), "b": (True, 1)} and rows.count() == 3
    registry.check_required(health, rows)
    with pytest.raises(registry.RequiredSourceError):
        registry.check_required(health, rows.limit(0))


def published(spark):
    rows = [record(i, title=f"A vision language model benchmark number {i}", url=f"https://x.org/{i}", published_at=datetime(2026, 7, 28, 6)) for i in range(5)]
    scan = run_scan(records(spark, rows), RULES, now())
    return scan.published.withColumn("scan_date", F.lit(date(2026, 7, 28)))


def test_snapshot_round_trip_replaces_only_its_date(spark, tmp_path):
    path, items = str(tmp_path / "snap"), published(spark)
    snapshots.write_snapshot(items, path)
    snapshots.write_snapshot(items.withColumn("scan_date", F.lit(date(2026, 7, 29))), path)
    snapshots.write_snapshot(items.limit(2), path)
    counts = {str(r["scan_date"]): r["count"] for r in snapshots.read_snapshots(spark, path).groupBy("scan_date").count().collect()}
    assert counts == {"2026-07-28": 2, "2026-07-29": 5}
    with pytest.raises(snapshots.SnapshotError):
        snapshots.write_snapshot(items.withColumn("categories", F.array().cast("array<string>")), path)
    assert snapshots.read_snapshots(spark, path).count() == 7


def test_staged_rows_are_written_several_times(spark, tmp_path):
    path, items = str(tmp_path / "snap"), published(spark)
    both = items.unionByName(items.withColumn("scan_date", F.lit(date(2026, 7, 29))))
    staged = snapshots.stage_snapshot(both)
    snapshots.write_snapshot(staged, path, staged=True)
    snapshots.write_snapshot(staged.where("scan_date = date '2026-07-29'").limit(3), path, staged=True)
    counts = {str(r["scan_date"]): r["count"] for r in snapshots.read_snapshots(spark, path).groupBy("scan_date").count().collect()}
    assert counts == {"2026-07-28": 5, "2026-07-29": 3}
    with pytest.raises(snapshots.SnapshotError):
        snapshots.write_snapshot(staged.withColumn("title", F.lit("")), path, staged=True)


def test_validation_computes_rows_once(spark):
    items = published(spark).withColumn("title", F.concat(F.lit("computed here "), F.col("title")))
    found = validate_snapshot(items.unionByName(items.limit(1)))
    assert "computed here" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r["violation"] for r in found.collect()] == ["duplicate item"]


def test_inverted_words_are_made_inside_the_row(spark):
    texts = ["b a b  c a b", "", "one", " ".join(f"w{i % 700}" for i in range(20_000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    made = df.select("doc_id", inverted(F.split("text", " ")).alias("index"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    for r in made.collect():
        want = {}
        for at, word in enumerate(texts[r.doc_id].split(" ")):
            want.setdefault(word, []).append(at)
        assert r["index"] == want


def test_unreadable_files_cost_their_own_rows(spark, tmp_path):
    folder = tmp_path / "in"
    spark.range(60).repartition(3).write.parquet(str(folder))
    (folder / "broken.parquet").write_bytes(b"PAR1 no footer")
    (folder / "sub #1").mkdir()
    spark.range(5).coalesce(1).write.mode("overwrite").parquet(str(folder / "sub #1" / "more"))
    rows, files = registry.payload_files(spark, str(folder), "id bigint")
    assert rows.count() == 65 and files.count() == 5
    assert sorted(r["_file"].rsplit("/", 1)[1] for r in files.where("NOT ok").collect()) == ["broken.parquet"]
    health = registry.file_health({"a": files, "b": files.where("ok")})
    assert {r["source_key"]: (r["files"], r["bad_files"], r["detail"]) for r in health.collect()} == {"a": (5, 1, "broken.parquet"), "b": (4, 0, "")}


def test_item_lines_and_documents_hold_the_same_items(spark, tmp_path):
    scored = run_scan(records(spark, [record(i, title=f"A title that is surely long enough {i}", venue="") for i in range(6)]), RULES, now()).scored
    dated = scored.withColumn("scan_date", F.date_add(F.lit("2026-07-01").cast("date"), (F.col("position") % 2).cast("int")))
    lines, nested = str(tmp_path / "lines"), str(tmp_path / "nested")
    snapshots.write_item_lines(dated, lines)
    snapshots.write_item_lines(dated.where("scan_date = date '2026-07-02'"), lines)
    snapshots.write_documents(dated, nested)
    read = lambda df: sorted((str(r["scan_date"]), r["source_id"], r["title"], r["total_score"], tuple(r["authors"] or ()), r["venue"]) for r in df.collect())
    rows = read(snapshots.read_item_lines(spark, lines))
    assert rows == read(snapshots.read_documents(spark, nested)[0]) and len(rows) == 6 and rows[0][-1] is None
    (tmp_path / "lines" / "scan_date=2026-07-02" / "bad.json").write_text("no json")
    with pytest.raises(Exception, match="(?i)malformed"):
        snapshots.read_item_lines(spark, lines).collect()


def test_public_projection_drops_empty_fields(spark):
    many = [record(0, authors=[f"a{i}" for i in range(20)], artifact_urls=[f"u{i}" for i in range(20)], metrics={"likes": 1.005})]
    scored = run_scan(records(spark, many), RULES, now()).scored
    body = json.loads(snapshots.public_json(scored).first()["item"])
    assert len(body["authors"]) == 20 and len(body["artifact_urls"]) == 20
    short = json.loads(snapshots.public_json(scored, caps=snapshots.DIGEST_CAPS).first()["item"])
    assert len(short["authors"]) == 12 and len(short["artifact_urls"]) == 8
    assert "venue" not in body and "updated_at" not in body and body["categories"] == ["benchmark"]


def test_documents_by_date(spark, tmp_path):
    item = {"source": "arXiv", "source_id": "1", "title": "t", "url": "u", "categories": ["c"], "total_score": 50.0, "provenance": "live"}
    doc = {"schema_version": 1, "selection": {"fetched": 3, "published": 1}, "health": [{"source": "arXiv", "ok": True, "item_count": 3}], "items": [item]}
    (tmp_path / "2026-07-01.json").write_text(json.dumps({**doc, "date": "2026-07-01"}, indent=2))
    (tmp_path / "2026-07-02.json").write_text(json.dumps(doc, indent=2))
    items, health, funnels = snapshots.read_documents(spark, str(tmp_path))
    assert sorted(str(r["scan_date"]) for r in items.collect()) == ["2026-07-01", "2026-07-02"]
    assert health.count() == 2 and funnels.agg(F.sum("fetched")).first()[0] == 6
    (tmp_path / "2026-07-03.json").write_text("{broken")
    with pytest.raises(Exception):
        snapshots.read_documents(spark, str(tmp_path))[0].collect()


def test_boilerplate_stops_a_scan(spark):
    same = "The very same sentence that a broken parser put on each and every record."
    rows = [record(i, title=f"A vision language model benchmark number {i}", url=f"https://x.org/{i}", summary=same) for i in range(4)]
    with pytest.raises(BoilerplateError):
        run_scan(records(spark, rows), RULES, now())


def test_backfill_skips_existing_dates_and_scores_as_of_report(spark):
    day = lambda i: date(2026, 7, 1 + i)
    rows = [record(i, title=f"A vision language model benchmark number {i // 2}", provenance="curated", published_at=datetime(2026, 7, 1 + i)) for i in range(4)]
    entries = records(spark, rows).withColumn("scan_date", F.date_add(F.lit(day(0)), F.col("position").cast("int")))
    existing = spark.createDataFrame([(day(1),)], "scan_date date")
    done, funnels = run_backfill(entries, RULES, existing, selection=SelectConfig(minimum_score=10.0))
    got = {r["scan_date"]: r["recency_score"] for r in done.collect()}
    assert got == {day(0): 100.0, day(2): 100.0, day(3): 100.0} and funnels.count() == 3


def test_fingerprint_ignores_the_order_of_nested_keys(spark):
    from tidemark.operators.quality import payload_hash

    first = spark.sql("SELECT 1 AS a, map('x', named_struct('p', 1, 'q', 2), 'y', NULL) AS m, array(named_struct('k', 1, 'j', map('b', 1, 'a', 2))) AS l")
    second = spark.sql("SELECT array(named_struct('j', map('a', 2, 'b', 1), 'k', 1)) AS l, map('y', NULL, 'x', named_struct('q', 2, 'p', 1)) AS m, 1 AS a")
    other = spark.sql("SELECT array(named_struct('j', map('a', 2, 'b', 9), 'k', 1)) AS l, map('y', NULL, 'x', named_struct('q', 2, 'p', 1)) AS m, 1 AS a")
    hashes = [df.select(payload_hash(df.columns, df.schema)).first()[0] for df in (first, second, other)]
    assert hashes[0] == hashes[1] != hashes[2]


def test_registered_sources_count_unreadable_payloads(spark):
    good = '[{"full_name": "me/x", "html_url": "https://github.com/me/x", "created_at": "2026-07-27T00:00:00Z"}]'
    tables = {"repos": payloads(spark, [good, "{broken", "no"], query=["q"] * 3), "works": payloads(spark, ["nope"], query=["q"])}
    rows, health = registry.collect_registered(spark, tables, clock(), required=("repos",))
    got = {r["source_key"]: (r["label"], r["unreadable"], r["ok"]) for r in health.collect()}
    assert got == {"repos": ("GitHub", 2, True), "works": ("OpenAlex", 1, True)}
    assert rows.where("source_key = 'works'").count() == 0
    with pytest.raises(KeyError):
        registry.collect_registered(spark, {"other": tables["repos"]}, clock())
