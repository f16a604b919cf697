import random
from datetime import date
from statistics import median_low

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dedupe, graph, ranks, rollup
from tidemark.operators.skew import join_counts
from tidemark.operators.documents import group_by_array, group_sizes, neighbour_docs, sorted_tags

from .helpers import hours_ago, record, records

TITLE = "A shared title that is long enough to merge"


def brute_merge(rows):
    """Merge dict rows the slow way: freshest first, later ones only add."""
    out = {}
    for r in sorted(rows, key=lambda r: (-(r["fresh"]), r["position"])):
        p = out.get(r["key"])
        if p is None:
            out[r["key"]] = {**r, "corr": [], "copies": 1, "urls": list(r["urls"]), "authors": list(r["authors"]), "metrics": dict(r["metrics"])}
            continue
        p["copies"] += 1
        if r["source"] != p["source"] and r["source"] not in p["corr"]:
            p["corr"].append(r["source"])
        for u in [r["url"], *r["urls"]]:
            if u and u != p["url"] and u not in p["urls"]:
                p["urls"].append(u)
        for a in r["authors"]:
            if a not in p["authors"]:
                p["authors"].append(a)
        for k, v in r["metrics"].items():
            p["metrics"][k] = max(p["metrics"].get(k, 0.0), v)
        p["summary"] = p["summary"] or r["summary"]
    return out


def test_merge_equals_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    raw = []
    for i in range(400):
        key = 0 if rng.random() < 0.4 else rng.randrange(1, 150)
        raw.append(
            dict(key=key, position=i, fresh=rng.randrange(20), source=f"s{rng.randrange(4)}", url=f"http://u/{rng.randrange(9)}",
                 urls=[f"http://u/{rng.randrange(9)}" for _ in range(rng.randrange(3))], authors=[f"a{rng.randrange(6)}" for _ in range(rng.randrange(3))],
                 metrics={f"m{rng.randrange(3)}": float(rng.randrange(1, 50))}, summary=rng.choice(["", "text"]))
        )
    rows = [
        record(r["position"], title=f"{TITLE} {r['key']}", source=r["source"], url=r["url"], artifact_urls=r["urls"], authors=r["authors"],
               metrics=r["metrics"], summary=r["summary"], published_at=hours_ago(100 - r["fresh"]))
        for r in raw
    ]
    expected = {
        f"{TITLE} {k}": (p["position"], p["copies"], p["corr"], p["urls"], p["authors"], p["metrics"], p["summary"]) for k, p in brute_merge(raw).items()
    }
    for parts in (1, 6):
        merged = dedupe.merge_duplicates(records(spark, rows).repartition(parts)).collect()
        got = {
            r["title"]: (r["position"], r["copies"], r["corroborating_sources"], r["artifact_urls"], r["authors"], r["metrics"], r["summary"]) for r in merged
        }
        assert got == expected


def test_copies_lend_texts_and_repeated_rows_leave_one(spark):
    rows = [
        record(0, title=f"{TITLE} x", summary="", venue="", published_at=hours_ago(1)),
        record(1, title=f"{TITLE} x", summary="older text", venue="", published_at=hours_ago(2)),
        record(2, title=f"{TITLE} x", summary="oldest", venue="Venue", published_at=hours_ago(3)),
        record(3, title=f"{TITLE} y", summary="twice"), record(3, title=f"{TITLE} y", summary="twice"),
        record(4, title=f"{TITLE} z", summary="alone", published_at=None),
    ]
    df = records(spark, rows)
    merged = dedupe.merge_duplicates(df)
    got = {r["title"][-1]: (r["position"], r["copies"], r["summary"], r["venue"]) for r in merged.collect()}
    assert got == {"x": (0, 3, "older text", "Venue"), "y": (3, 2, "twice", ""), "z": (4, 1, "alone", "")}
    assert set(df.columns) < set(merged.columns) and dedupe.merge_duplicates(df.where("false")).count() == 0
    # Dates apart: the same key in two scans is two records.
    dated = df.unionByName(df).withColumn("scan_date", F.when(F.col("position") < 2, F.lit("a")).otherwise(F.lit("b")))
    assert dedupe.merge_duplicates(dated, by=("scan_date",)).count() == 4


def test_rows_of_single_keys_are_not_shuffled(spark):
    df = records(spark, [record(i, title=f"{TITLE} {i}") for i in range(4)])
    plan = dedupe.merge_duplicates(df)._jdf.queryExecution().optimizedPlan().toString()
    # The last input of the union is the path of single keys: a scan, a broadcast anti join, a projection.
    single = plan[plan.rindex("LeftAnti") :]
    assert "Aggregate" not in single and "Repartition" not in single and "strategy=broadcast" in plan


def test_join_counts_with_few_hot_keys_equals_plain_join(spark):
    rng = random.Random(9)
    rows = [(i, 0 if rng.random() < 0.5 else rng.randrange(40)) for i in range(2000)]
    left = spark.createDataFrame(rows, "i int, k int")
    counts = left.groupBy("k").agg(F.count("*").alias("n")).where("k % 3 = 0")
    for how in ("inner", "left_semi"):
        got = join_counts(left, counts, "k", "n", ["i"], how, partitions=7)
        want = left.join(counts, "k", how)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_short_titles_key_on_url(spark):
    rows = [
        record(0, title="Short", url="https://x.org/a?utm_source=q"), record(1, title="Other", url="https://X.org/a/"),
        record(2, title="Short", url="https://x.org/b"), record(3, title="Short", url=""),
    ]
    keys = [r[0] for r in dedupe.with_dedupe_key(records(spark, rows)).orderBy("position").select("dedupe_key").collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3


def test_first_by_prunes_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 3), (1, 2), (2, 5)], "k int, v int")
    first = dedupe.first_by(df, ["k"], [F.col("v")])
    # Before it runs, the plan is printed once: one limit on each side of the exchange.
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted(map(tuple, first.collect())) == [(1, 2), (2, 5)]


def test_artifact_identity(spark):
    cases = [
        ("arXiv", "x", "https://arxiv.org/abs/2607.00001v2", [], {}, "arxiv:2607.00001"),
        ("S", "x", "https://huggingface.co/papers/2607.00001", [], {}, "arxiv:2607.00001"),
        ("S", "x", "https://arxiv.org/pdf/2607.00001", [], {"doi": ["10.1234/ABC.;"]}, "doi:10.1234/abc"),
        ("Hugging Face Models", "Org/M", "https://github.com/a/b", [], {}, "hf:org/m"),
        ("S", "x", "https://huggingface.co/datasets/Org/D.1", [], {}, "hf:org/d.1"),
        ("S", "x", "https://huggingface.co/spaces/a/b", ["https://huggingface.co/real/repo"], {}, "url:https://huggingface.co/spaces/a/b"),
        ("S", "x", "https://e.org", ["https://GitHub.com/A/B.git"], {}, "gh:a/b"),
        ("S", "x", "https://E.org/P/?ref=1", [], {}, "url:https://e.org/p"),
        ("My Source", "I D", "", [], {}, "id:my-source-i-d"),
        ("S", "x", "https://z.org", [], {"arxiv_id": ["2601.12345"]}, "arxiv:2601.12345"),
    ]
    rows = [record(i, source=c[0], source_id=c[1], url=c[2], artifact_urls=c[3], facets=c[4]) for i, c in enumerate(cases)]
    got = dedupe.with_artifact_key(records(spark, rows)).orderBy("position").select("artifact_key").collect()
    assert [r[0] for r in got] == [c[5] for c in cases]


def test_overlap_prefers_reports(spark):
    rows = lambda n, u: records(spark, [record(n, title="Same Title", url=u, source_id=f"r{n}")])
    kept = dedupe.dedupe_overlap(rows(5, "http://a"), rows(1, "http://a").unionByName(rows(2, "http://b"))).collect()
    assert sorted(r["source_id"] for r in kept) == ["r2", "r5"]


def items(spark):
    rows = [
        (date(2026, 7, 1), 0, "arXiv", "First name", "https://arxiv.org/abs/2607.00001", 40.0, "live", ["t1"], ["Org A"], []),
        (date(2026, 7, 2), 0, "GitHub", "Later name", "https://arxiv.org/pdf/2607.00001", 60.0, "curated", ["t1", "t2"], ["org a", " "], ["Fam"]),
        (date(2026, 7, 4), 1, "arXiv", "Similar name", "https://x.org/2", 50.0, "live", ["t2"], [], []),
        (date(2026, 7, 4), 0, "arXiv", "Third", "https://x.org/3", 50.0, "live", ["t3"], [], ["Fam"]),
    ]
    schema = (
        "scan_date date, position bigint, source string, title string, url string, total_score double, provenance string, "
        "categories array<string>, organizations array<string>, model_families array<string>"
    )
    df = spark.createDataFrame(rows, schema)
    empty = F.array().cast("array<string>")
    return df.withColumns(
        {"source_id": F.col("title"), "artifact_urls": empty, "corroborating_sources": F.when(F.col("source") == "GitHub", F.array(F.lit("arXiv"))).otherwise(empty), "watchlist": empty, "event_kind": F.lit("published")}
    )


def test_graph_nodes_edges_and_cap(spark):
    nodes = {r["id"]: r for r in graph.graph_nodes(items(spark), {"t1": "Topic one"}).collect()}
    paper = nodes["arxiv:2607.00001"]
    assert (paper["label"], paper["observations"], paper["score"], paper["provenance"]) == ("First name", 2, 60.0, "curated")
    assert paper["url"] == "https://arxiv.org/abs/2607.00001"
    assert nodes["topic:t1"]["label"] == "Topic one" and nodes["topic:t2"]["label"] == "T2"
    assert nodes["org:org-a"]["label"] == "Org A" and nodes["org:org-a"]["observations"] == 2
    assert nodes["source:arxiv"]["observations"] == 4
    kept, edges, summary = graph.build_graph(items(spark), {}, max_artifacts=1)
    assert [r["id"] for r in kept.where("kind = 'artifact'").collect()] == ["arxiv:2607.00001"]
    assert summary.first()["artifact_count"] == 3 and summary.first()["generated_from_days"] == 3
    weights = {(r["target"], r["relation"]): r["weight"] for r in edges.collect()}
    assert weights == {
        ("source:arxiv", "FOUND_VIA"): 2, ("source:github", "FOUND_VIA"): 1, ("topic:t1", "HAS_TOPIC"): 2, ("topic:t2", "HAS_TOPIC"): 1,
        ("org:org-a", "RELEASED_BY"): 2, ("family:fam", "TRACKS_FAMILY"): 1,
    }
    all_edges = graph.graph_edges(items(spark), {})
    assert graph.retain_edges(all_edges, kept).count() == len(weights)
    assert {r["source"] for r in graph.neighbours(all_edges, "topic:t3").collect()} == {"url:https://x.org/3"}


def test_graph_of_partials_equals_the_full_build(spark, tmp_path):
    path, all_items = str(tmp_path / "graph"), items(spark)
    changed = all_items.withColumn("total_score", F.col("total_score") + 30)
    days = lambda df, *ds: df.where(F.col("scan_date").cast("string").isin(*ds))
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    graph.write_graph_partials(days(all_items, "2026-07-01", "2026-07-04"), {}, path)
    # A scan is added, then one is replaced.
    graph.write_graph_partials(days(all_items, "2026-07-02"), {}, path)
    for part, full in zip(graph.graph_from_partials(spark, path, 2), graph.build_graph(all_items, {}, 2)):
        assert order(part.select(*full.columns)) == order(full)
    graph.write_graph_partials(days(changed, "2026-07-04"), {}, path)
    now = days(all_items, "2026-07-01", "2026-07-02").unionByName(days(changed, "2026-07-04"))
    for part, full in zip(graph.graph_from_partials(spark, path, 2), graph.build_graph(now, {}, 2)):
        assert order(part.select(*full.columns)) == order(full)


def test_records_of_a_node(spark):
    found = lambda *node: sorted(r["title"] for r in graph.records_of_node(items(spark), *node).collect())
    assert found("topic", "t2") == ["Later name", "Similar name"] and found("source", "GitHub") == ["Later name"]
    assert found("model_family", "Fam") == ["Later name", "Third"] and found("organization", "nobody") == []


def test_trends_compare_with_previous_scan(spark):
    rows = {(str(r["scan_date"]), r["category"]): r for r in rollup.category_trends(items(spark)).collect()}
    assert not rows[("2026-07-01", "t1")]["comparable"]
    last = {k[1]: (v["count"], v["baseline"], v["delta"]) for k, v in rows.items() if k[0] == "2026-07-04"}
    assert last == {"t1": (0, 1, -1), "t2": (1, 1, 0), "t3": (1, 0, 1)}
    assert len(rows) == 6


def test_velocity_counts_observed_days(spark):
    rows = {r["category"]: r for r in rollup.velocity(items(spark), {}, window=2).collect()}
    assert (rows["t1"]["recent"], rows["t1"]["prior"], rows["t1"]["delta"]) == (1, 1, 0)
    assert rows["t3"]["recent"] == 1 and rows["t2"]["total"] == 2 and rows["t1"]["comparable"]


def test_global_rank_and_neighbours_with_ties(spark):
    rng = random.Random(1)
    rows = [(f"m{i:05d}", 0 if i % 3 else rng.randrange(50)) for i in range(5000)]
    df = spark.createDataFrame(rows, "name string, v int").repartition(6)
    expected = {n: i + 1 for i, (_, n) in enumerate(sorted((-v, n) for n, v in rows))}
    ranked = ranks.with_global_rank(df, F.struct((-F.col("v")).alias("a"), F.col("name").alias("b")))
    assert {r["name"]: r["rank"] for r in ranked.collect()} == expected
    order = sorted(n for n, _ in rows)
    near = neighbour_docs(df, F.struct("name"), "name").collect()
    at = {n: i for i, n in enumerate(order)}
    for r in near:
        i = at[r["name"]]
        assert r["previous"] == (order[i - 1] if i else None) and r["next"] == (order[i + 1] if i + 1 < len(order) else None)


@pytest.mark.parametrize("partitions", ["1", "200"])
def test_ranks_do_not_depend_on_partitions(spark, partitions):
    settings = {"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, x in settings.items():
            spark.conf.set(k, x)
        rng = random.Random(4)
        values = rng.sample(range(10_000), 700)
        df = spark.createDataFrame([(x, None if x % 5 == 0 else f"v{x}") for x in values], "k int, name string").repartition(7)
        order = sorted(values)
        ranked = ranks.with_global_rank(df, F.struct("k")).collect()
        assert {r["k"]: r["rank"] for r in ranked} == {x: i + 1 for i, x in enumerate(order)}
        name = lambda i: None if not 0 <= i < len(order) or order[i] % 5 == 0 else f"v{order[i]}"
        near = {r["k"]: (r["previous"], r["next"]) for r in ranks.with_neighbours(df, F.struct("k"), "name").collect()}
        assert near == {x: (name(i - 1), name(i + 1)) for i, x in enumerate(order)}
        assert ranks.with_global_rank(df.where("false"), F.struct("k")).count() == 0
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


def test_lower_median_by_counting(spark):
    rng = random.Random(5)
    cases = [[3.0], [1.0, 2.0], [5.0] * 40 + [1.0], [rng.random() for _ in range(301)], [1e300, -1e300, *[rng.gauss(0, 1) for _ in range(200)]], [float(rng.randrange(4)) for _ in range(100)]]
    for values in cases:
        df = spark.createDataFrame([(v,) for v in [*values, None]], "c double").repartition(3)
        for few in (100_000, 5):
            assert ranks.lower_median(df, "c", bins=8, few=few) == median_low(values)
    assert ranks.lower_median(df.where("false"), "c") is None


def test_document_lists(spark):
    df = spark.createDataFrame([(1, ["b", "A", "a"]), (2, ["A", "A"])], "id int, tags array<string>")
    assert [tuple(r) for r in group_sizes(df, "tags").collect()] == [("A", 2), ("a", 1), ("b", 1)]
    groups = group_by_array(df, "tags", ["id"]).select("group_name", "id", "group_size").collect()
    assert sorted(map(tuple, groups)) == [("A", 1, 2), ("A", 2, 2), ("a", 1, 1), ("b", 1, 1)]
    assert sorted_tags(df, "tags").where("id = 1").first()["sorted_tags"] == ["A", "a", "b"]
