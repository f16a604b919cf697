"""Similarity groups, components, sharding, packing, token files, WARC, pages and toxicity."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, html_extract, jaccard, packing, sharding, token_counts, toxicity, warc
from tidemark.plans.storage import scratch

from . import brute

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------------------ similarity

def edited(seed, n, sizes=(1, 3, 4, 5, 7, 12, 30, 90)):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(40)}"
    base = [[word() for _ in range(rng.choice(sizes))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(int(len(words) * rng.choice([0, 0, 0.02, 0.05, 0.09]))):
            words[rng.randrange(len(words))] = word()
        if rng.random() < 0.15:
            words += base[0]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    rows = edited(seed, 220) + [(900, None), (901, ""), (902, "  \n"), (903, "A b C d"), (904, "a B c D"), (905, "a b c")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(table(spark, rows)).collect()}
    assert got == brute.groups(rows)


def test_bounds_are_met_exactly(spark):
    # 12 of 16 shingles in common is 75 percent, 11 of 17 is not.
    rows = [(5, " ".join(f"a{i}" for i in range(18))), (3, " ".join([f"a{i}" for i in range(16)] + ["x", "y"])), (4, " ".join([f"a{i}" for i in range(15)] + ["p", "q", "r"]))]
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(table(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in brute.groups(rows).items()}


def test_long_sets_and_chains(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10_000)}" for _ in range(1500)]
    rows = []
    for i in range(14):  # neighbours are alike, the ends of the chain are not
        rows.append((i, " ".join(words)))
        for _ in range(26):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10_000)}"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(table(spark, rows)).collect()}
    assert got == brute.groups(rows)


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    for n in [1, 2, 3, 4, 7, 48, 63, 64, 65, 96, 100, 128, 129, 700, 1025, 3000]:
        for _ in range(40):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            drop = int(rng.integers(0, n // 4 + 1))
            add = int(rng.integers(0, max(1, (n - drop) * 4 // 3 - n + 1)))
            b = np.concatenate([a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                assert len(np.intersect1d(jaccard.signatures(a, *none), jaccard.signatures(b, *none)))


def test_repeated_ids_null_ids_and_empty_tables(spark):
    text = "one two three four five six"
    rows = [(7, text), (7, text), (None, text), (2, text), (None, "else"), (9, None)]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.similar_groups(table(spark, rows)).collect()), key=str)
    assert got == sorted([(7, 2), (7, 2), (None, 2), (2, 2), (None, None), (9, 9)], key=str)
    assert jaccard.similar_groups(table(spark, [])).count() == 0


def test_texts_of_a_repeated_id_are_linked_each(spark):
    words = [[f"{c}{i}" for i in range(40)] for c in "abc"]
    near = [" ".join(w[:-1] + ["other"]) for w in words]
    a, b, c = (" ".join(w) for w in words)
    rows = [(5, near[0]), (5, near[1]), (7, b), (6, a), (5, near[2]), (3, c), (3, c), (3, a + " x"), (9, "alone in here"), (9, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(table(spark, rows)).collect()), key=str)
    sets = brute.groups(list(enumerate(t for _, t in rows)))
    least = {}
    for i, (_, g) in sets.items():
        least[g] = min(least.get(g, rows[i][0]), rows[i][0])
    assert got == sorted(((rows[i][0], n, least[g]) for i, (n, g) in sets.items()), key=str)
    assert [c for i, _, c in got if i == 7] == [5] and [c for i, _, c in got if i == 6] == [3]


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(40)] + [(100, rng.randrange(101, 130)) for _ in range(40)] + [(5, 5), (200, 199)]
    got = {r.id: r.component for r in components.smallest_reachable(table(spark, links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in {100, *(b for a, b in links if a == 100)}} | {200: 199, 199: 199}


# -------------------------------------------------------------------------------- sharding

@pytest.mark.parametrize("limit", [50, 400, 10**6])
def test_shards_equal_splitting_one_by_one(spark, limit):
    rng = random.Random(limit)
    rows = [(rng.randrange(10**6), "x" * rng.randrange(60)) for _ in range(150)] + [(1, "hot" * i) for i in range(60)] + [(3, None), (None, "y"), (4, "same")] + [(5, "copy" * 9)] * 40
    df = table(spark, rows).withColumns({"shard": F.lit(1), "row_bytes": F.lit("x")})
    hashed = [r.h for r in table(spark, rows).select(sharding.hash_bits(F.col("doc_id"), F.col("text")).alias("h")).collect()]
    want = brute.shards([len(t or "") for _, t in rows], hashed, limit, sharding.BITS)
    got = sharding.shard(df, "doc_id", "text", limit).collect()
    assert sorted((str(r.doc_id), str(r.text), r.shard) for r in got) == sorted((str(rows[i][0]), str(rows[i][1]), p) for i, p in want.items())
    sums = {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r.row_bytes
    assert all(r.shard_bytes == sums[r.shard] and (r.oversized == (sums[r.shard] > limit)) for r in got)


def test_sharding_an_empty_table(spark):
    assert sharding.shard(table(spark, []), "doc_id", "text").count() == 0


# --------------------------------------------------------------------------------- packing

def test_best_fit_takes_the_tightest_window():
    rng = random.Random(9)
    lengths = sorted((rng.randrange(1, 101) for _ in range(400)), reverse=True)
    rooms, want = [], []
    for n in lengths:
        fits = [i for i, room in enumerate(rooms) if room >= n]
        if fits:
            least = min(rooms[i] for i in fits)
            want.append(100 - least)
            rooms[next(i for i in fits if rooms[i] == least)] -= n
        else:
            want.append(0)
            rooms.append(100 - n)
    windows, offsets, opened = packing.best_fit_decreasing(lengths, 100)
    assert opened == len(rooms) and sorted(offsets) == sorted(want)
    used = {}
    for n, w, o in zip(lengths, windows, offsets):
        assert used.get(w, 0) == o
        used[w] = o + n
    assert sorted(100 - u for u in used.values()) == sorted(rooms)


def test_pieces_hold_every_id_once(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    rng = random.Random(10)
    texts = [None, "", " ", "É <|endoftext|> it's", "a\x0bb\x85c d"] + [" ".join(f"wört{rng.randrange(99)}!" for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    got = packing.pack(table(spark, rows), WORD_BPE, window=256, tokens_per_task=4000).collect()
    sequences, docs = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 256
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for r in docs[i]:
            piece = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(piece)
        assert sum(r.length for r in docs[i]) == len(ids) * (2 if i == 3 else 1)
    assert packing.pack(table(spark, []), WORD_BPE).count() == 0


# ----------------------------------------------------------------------------- token files

@pytest.mark.parametrize("block", [1, 3, 1000])
def test_token_counts_across_blocks(spark, tmp_path, block):
    files, want = [], {}
    for name, ids in {"a": [5, 9, 9, 7, 7, 7, 9], "b": [1, 2], "c": [9], "d": [], "e": [9, 4, 4, 4, 4]}.items():
        path = tmp_path / name
        path.write_bytes(np.array(ids, "<u2").tobytes())
        files.append((str(path), len(ids)))
        want[name] = [len(p.split()) for p in " ".join(map(str, ids)).split("9")]
        if not want[name][-1]:
            want[name].pop()
    out = token_counts.token_counts(table(spark, files, "path string, tokens long"), 9, block_tokens=block).orderBy("path", "position").collect()
    got = {n: [] for n in want}
    for r in out:
        got[r.path[-1]].append(r.n_tokens)
        assert r.ended == (r.path[-1] not in "be" or r.path[-1] == "e" and r.position == 0)
    assert got == want


def test_token_files_round_trip(spark):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoder = token_counts.byte_pair_encoder(ranks, public_tokenizers.PATTERN)
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|> é" * 50), (4, "twice")]
    files, placed = token_counts.write_token_files(table(spark, rows).repartition(3), scratch(spark, "tokens"), ranks, public_tokenizers.PATTERN, 50256)
    counts = token_counts.token_counts(files, 50256, block_tokens=16)
    got = sorted((r.doc_id, r.n_tokens) for r in placed.join(counts, ["path", "position"]).collect())
    assert got == sorted((i, len(encoder.encode_ordinary(t or ""))) for i, t in rows)


# ------------------------------------------------------------------------------------ WARC

def test_archives_round_trip(spark):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "http://c", big), (3, "http://c2", big), (4, "http://d", "small"), (5, "http://e", "small"), (6, "u", None), (None, "n", big)]
    df = table(spark, rows, "page_id long, url string, html string")
    archives = warc.write_archives(df, scratch(spark, "warc"), roll_bytes=300)
    assert archives.count() > 1
    out = warc.read_archives(archives, with_payload=True).collect()
    assert all(r.error is None for r in out)
    got = sorted((str(r.record_id), r.record_type, str(r.refers_to), r.payload_bytes, r.payload) for r in out)
    size = len(big.encode())
    want = [("1", "3"), ("2", "3"), ("3", None), ("3", None), ("None", "3")]
    expected = [(f"urn:page:{i}", "revisit" if to else "response", f"urn:page:{to}" if to else "None", size, None if to else big.encode()) for i, to in want]
    expected += [("urn:page:4", "response", "None", 5, b"small"), ("urn:page:5", "response", "None", 5, b"small"), ("urn:page:6", "response", "None", 0, b"")]
    assert got == sorted(expected, key=lambda x: tuple(map(str, x))) or sorted(got, key=str) == sorted(expected, key=str)
    assert len({r.payload_digest for r in out}) == 3
    assert warc.read_archives(warc.write_archives(df.where("false"), scratch(spark, "warc"))).count() == 0


def member(**over):
    return warc.gzip_member(warc.record_bytes("urn:page:1", "http://a", b"payload" * 100))


@pytest.mark.parametrize(("damage", "says"), [
    (lambda b: b[: len(b) // 2], "ends inside"),
    (lambda b: b + b"garbage", "gzip"),
    (lambda b: warc.gzip_member(zlib.decompress(b, 31).replace(b"payloadpayload", b"payloadPAYLOAD", 1)), "digest"),
    (lambda b: warc.gzip_member(zlib.decompress(b, 31)[:-4]), "Content-Length"),
    (lambda b: warc.gzip_member(zlib.decompress(b, 31) * 2), "Content-Length"),
    (lambda b: warc.gzip_member(b"junk"), "header"),
])
def test_damaged_archives_say_so(damage, says):
    rows = list(warc.read_records(io.BytesIO(member() + damage(member()))))
    assert rows[0]["error"] is None and rows[-1]["error"]
    assert says in rows[-1]["error"] or "gzip member" in rows[-1]["error"] or "longer" in rows[-1]["error"]


@pytest.mark.parametrize("damage", [lambda b: b[:-9], lambda b: b[: len(b) // 2], lambda b: b"", lambda b: b + b"garbage"])
def test_round_trip_fails_on_damaged_archives(spark, monkeypatch, damage):
    write = warc.write_archives

    def damaged(*args):
        archives = write(*args)
        path = archives.first().path.removeprefix("file:")
        with open(path, "rb") as f:
            data = f.read()
        with open(path, "wb") as f:
            f.write(damage(data))
        return archives

    df = table(spark, [(1, "http://a", "x" * 900), (2, "http://b", "y" * 900)], "page_id long, url string, html string").coalesce(1)
    assert warc.round_trip(spark, df).count() == 2
    monkeypatch.setattr(warc, "write_archives", damaged)
    with pytest.raises(Exception, match="warc.gz"):
        warc.round_trip(spark, df).collect()


def test_long_records_are_read_in_steps():
    payload = bytes(range(256)) * 20_000
    data = warc.gzip_member(warc.record_bytes("urn:page:1", None, payload)) * 2
    rows = list(warc.read_records(io.BytesIO(data), with_payload=True))
    assert [r["payload"] == payload for r in rows] == [True, True] and rows[0]["url"] is None


# ----------------------------------------------------------------------------------- pages

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header>Site</header><nav><ul><li>Home<li>More</ul></nav>
<div class="wrap"><div class="%s"><article><h1>Head &amp; line</h1><p>Some   text with <b>bold</b> words that run for a while and on.<p>Second<br>paragraph &eacute; of the text, which is long enough.</p>
<div class="ad">Buy</div><form><p>mail</p></form><script>if (a < b) "</p>"</script><section id="comments"><p>nice</p></section></article></div><div class="sidebar">Side</div></div><footer>foot</footer></body></html>"""
TEXT = "Head & line\n\nSome text with bold words that run for a while and on.\n\nSecond paragraph é of the text, which is long enough."


def test_pages_of_a_host_vote(spark):
    plain = "<body><div class='content-9'><p>Short one.</p></div><div class='other'><p>" + "Chatter that is longer than the article, and more of it. " * 3 + "</p></div></body>"
    rows = [(i, f"https://Host.example/{i}", f"<body><div class='content-{i}'><p>{'An article that is of some length and runs on. ' * 5}</p></div></body>") for i in range(6)]
    rows += [(6, "http://u@host.example:80/x", plain), (7, None, PAGE % "main"), (8, "http://b/", None), (9, "http://b/", ""), (10, "no url", "text only"), (7, None, PAGE % "main")]
    df = table(spark, rows, "page_id long, url string, html string").withColumn("path", F.lit(1))
    got = html_extract.extract_pages(df).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert text[6] == "Short one."  # the host's winning path, though another container is longer
    assert text[7] == TEXT and (text[8], text[9]) == ("", "") and text[10] == "text only"
    assert html_extract.extract_pages(df.where("false")).count() == 0


RUN = "A sentence of the article that is of some length and runs on. "


@pytest.mark.parametrize(("page", "want"), [
    (f"<article><h1>Head</h1><p>Lead.</p><div class='body'><p>{RUN * 9}</p></div><p>End.</p></article>", ["Head", "Lead.", (RUN * 9).strip(), "End."]),
    (f"<main><section class='intro'><p>{RUN}</p></section><section class='details'><p>{RUN * 9}</p></section></main>", [RUN.strip(), (RUN * 9).strip()]),
    (f"<main><p>Top.</p><article class='post'><p>Lead.</p><div><p>{RUN * 9}</p></div></article></main>", ["Lead.", (RUN * 9).strip()]),
    (f"<div class='page'><h1>Head</h1><p><a href='/'>All posts</a></p><div class='body'><p>{RUN * 9}</p></div><div class='x'><p>Beside.</p></div><p>End.</p></div>", ["Head", (RUN * 9).strip(), "End."]),
])
def test_text_beside_an_inner_container_stays(spark, page, want):
    short = page.replace(RUN * 9, RUN)  # a page where the inner container alone would not win
    rows = [(i, "http://a/", f"<body>{page}</body>") for i in range(4)] + [(9, "http://a/", f"<body>{short}</body>"), (10, None, f"<body>{page}</body>")]
    got = {r.page_id: r.text for r in html_extract.extract_pages(table(spark, rows, "page_id long, url string, html string")).collect()}
    assert got[0] == got[10] == "\n\n".join(want) and html_extract.Page(f"<body>{page}</body>").text(None) == got[0]
    assert got[9] == "\n\n".join(RUN.strip() if t == (RUN * 9).strip() else t for t in want)


@pytest.mark.parametrize(("page", "want"), [
    (f"<article><h1>Head</h1><h2 id='search-results'>Results</h2><section class='discussion'><p>{RUN}</p></section><p id='reply-to-critics'>Reply.</p></article>", ["Head", "Results", RUN.strip(), "Reply."]),
    (f"<article><p>{RUN}</p><section id='related-work'><h2>Related</h2><p>{RUN}</p></section><ul class='related'><li><a href='/1'>One more</a><li><a href='/2'>Two more</a></ul></article>", [RUN.strip(), "Related", RUN.strip()]),
    (f"<article><p>{RUN}</p><div class='search'><form><input name=q></form>Find it</div><div id='comments'><p>{RUN}</p></div><p class='advert'>Buy</p><h3 class='notice'>A heading</h3></article>", [RUN.strip(), "A heading"]),
    (f"<div class='page'><div class='intro'><p>{RUN}</p></div><div class='details'><p>{RUN * 9}</p></div></div>", [RUN.strip(), (RUN * 9).strip()]),
    (f"<div class='intro'><p>{RUN}</p></div><div class='details'><p>{RUN * 9}</p></div><div class='footer-links'><a href='/'>Home of the site and all of its many pages</a></div>", [RUN.strip(), (RUN * 9).strip()]),
    (f"<div class='x'><div class='body'><p>{RUN * 3}</p></div><div class='body'><p>{RUN * 2}</p></div><div class='body'><p>{RUN}</p></div></div>", [(RUN * 3).strip(), (RUN * 2).strip(), RUN.strip()]),
])
def test_sections_of_the_article_stay(spark, page, want):
    assert html_extract.Page(f"<body>{page}</body>").text(None) == "\n\n".join(want)
    # On a host of many pages what all repeat is not the article, what varies is.
    rows = [(i, "http://a/", f"<body><div class='claim'>{'The claim of the site, the same on every page.'}</div>{page.replace('sentence', f'line{i}')}</body>") for i in range(6)] + [(9, "http://b/", f"<body>{page}</body>")]
    got = {r.page_id: r.text for r in html_extract.extract_pages(table(spark, rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "\n\n".join(want)
    assert all(got[i] == "\n\n".join(want).replace("sentence", f"line{i}") for i in range(6))


def test_pages_of_the_tables_equal_a_plain_reader(spark):
    """The template of the tables marks its article, so a reader that takes its blocks says the same."""
    import os
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.blocks, self.open = [], False

        def handle_starttag(self, tag, attributes):
            self.open |= tag == "article"
            if tag in ("p", "h1", "article"):
                self.blocks.append("")
            elif tag == "br":
                self.handle_data(" ")

        def handle_endtag(self, tag):
            self.open &= tag != "article"

        def handle_data(self, data):
            if self.open:
                self.blocks[-1] += data

    folder = os.environ.get("TIDEMARK_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()}
    for r in pages.collect():
        reader = Reader()
        reader.feed(r.html or "")
        assert got[r.page_id] == "\n\n".join(t for t in (" ".join(b.split()) for b in reader.blocks) if t)


def test_internal_names_of_pages_do_not_clash(spark):
    names = ["_path", "_host", "_both", "host", "told", "both", "row", "html2", "votes", "pages", "key"]
    df = table(spark, [(1, "http://a/", f"<article><p>{RUN}</p></article>")], "page_id long, url string, html string").withColumns({c: F.lit(c) for c in names})
    (r,) = html_extract.extract_pages(df).collect()
    assert r.text == RUN.strip() and all(r[c] == c for c in names) and r.page_id == 1


@pytest.mark.parametrize(("page", "text"), [
    ("<p>a<p class='notice'>cookies<p>b", "a\n\nb"), ("<div><nav>menu</div><p>text", "text"), ("<nav><ul><li>a<li>b</ul></nav><p>c", "c"),
    ("a < b &lt; c <br> d", "a < b < c d"), ("<!-- x", ""), ("<p>&nbsp;&#x41;</p>", "A"), ("<article class='comment'><p>x</p></article><article><p>main</p></article>", "main"),
    ("<select><option>a<option>b</select>rest", "rest"), ("<p hidden>x</p><p style='display:none'>y</p>z", "z"), ("<p>open <script>var x='</p>'", "open"),
])
def test_odd_markup(page, text):
    assert html_extract.Page(page).text(None) == text


# -------------------------------------------------------------------------------- toxicity

def labelled(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ta", "re", "mi", "so", "lu", "ne"]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randrange(5, 90))], int(i % 4 == 0)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["vilewort", "grobian", "dreckig"]) + rng.choice(["", "en", "er"]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy(spark):
    rows = labelled(11, 700)
    df = table(spark, [r[:2] for r in rows])
    labels = table(spark, [(i, y) for i, _, y in rows if i < 400] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(df, model).collect()}
    right = sum((scores[i] >= 0.3) == bool(y) for i, _, y in rows if i >= 400)
    assert right / 300 >= 0.95


def test_scores_do_not_depend_on_the_size_of_the_sample(spark):
    # Half of the toxic texts hold no toxic word, so one in 19 clean texts is toxic: far below the threshold.
    toxic, clean = [t for _, t, y in labelled(13, 1200) if y], [t for _, t, y in labelled(14, 3600) if not y]
    rows = list(enumerate(toxic[:150] + clean[:150] + clean[150:2700]))
    df, labels = table(spark, rows), table(spark, [(i, int(i < 300)) for i, _ in rows], "doc_id long, toxic int")
    probe = table(spark, [(1, clean[-1])])
    for most in (400, 6000):
        model = toxicity.fit(df, labels, max_docs=most)
        assert 0.02 < toxicity.score_toxicity(probe, model).first().score < 0.12


def test_scores_of_odd_rows(spark):
    model = toxicity.train([(t, y) for _, t, y in labelled(12, 200)])
    df = table(spark, [(1, None), (2, ""), (3, " \n"), (4, "x" * 100_000), (4, "x" * 100_000)]).withColumn("Score", F.lit(2))
    rows = toxicity.score_toxicity(df, model).collect()
    assert len({r.score for r in rows if r.doc_id < 4}) == 1 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(df.where("false"), model).count() == 0
    assert toxicity.train([]).prior == 0.0
    assert toxicity.score_toxicity(df, toxicity.train([("only", 1)])).first().score == 1.0
