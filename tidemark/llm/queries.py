"""The registered queries of the corpus operators, over whole tables, with SQL where it can say the same."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import scratch
from . import alignment, decontaminate, html_extract, jaccard, licenses, merkle, packing, quality, sharding, simhash, token_counts, toxicity, warc
from .common import SPACES

QUERIES, ORACLES = {}, {}

#: Labels of rows with this remainder are held out, so they never train.
HELD_OUT = 2
TOXIC_FROM = 0.3


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(sharding.oracle())
def op1_extendible_shards(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return sharding.shard(docs, "doc_id", "text", keep=["doc_id"])


@query()
def op2_license_scan(spark, sf):
    found = licenses.scan_licenses(table(spark, sf, "documents"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score", "permitted",
    )


@query()
def op3_ngram_jaccard(spark, sf):
    return jaccard.similar_groups(table(spark, sf, "documents"))


@query()
def op4_token_counts(spark, sf):
    ranks, end_id = public_tokenizers.path("byte_bpe_50k.tiktoken"), 50256
    files, placed = token_counts.write_token_files(
        table(spark, sf, "documents"), scratch(spark, "token-files"), ranks, public_tokenizers.PATTERN, end_id
    )
    counts = token_counts.token_counts(files, end_id)
    return placed.join(counts, ["path", "position"]).select("doc_id", "n_tokens")


@query()
def op5_html_text(spark, sf):
    found = html_extract.extract_pages(table(spark, sf, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _quality_sql() -> str:
    either = ", ".join(f"'{x}'" for s in quality.STOP_WORDS for x in dict.fromkeys((s, s.capitalize())))
    bounds = {r.measure: r for r in quality.RULES}
    passes = " AND ".join(
        f"coalesce({name} {sign} {value}, true)"
        for name, r in bounds.items() for sign, value in ((">=", r.at_least), ("<=", r.at_most)) if value is not None
    )
    return f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, text, regexp_extract_all(text, '[^{SPACES}]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{SPACES}]')) AS lines FROM t),
places AS (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
windows AS (SELECT row, i, hash_count > 1 AS twice FROM (
  SELECT row, i, count(*) OVER (PARTITION BY row, word, w2, w3) AS hash_count FROM (
    SELECT row, i, word, lead(word) OVER x AS w2, lead(word, 2) OVER x AS w3 FROM places WINDOW x AS (PARTITION BY row ORDER BY i))
  WHERE w3 IS NOT NULL)),
repeated AS (SELECT row, count(DISTINCT j) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS j FROM windows WHERE twice) GROUP BY row),
m AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '{quality.SYMBOLS}', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(words, lambda x: x IN ({either}))) AS n_stop
  FROM w LEFT JOIN repeated USING (row)
),
r AS (SELECT *, word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(n_words, 0) AS symbols_per_word,
        n_stop / nullif(n_words, 0) AS stop_word_ratio, n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio,
        n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND {passes} AS kept FROM r"""


@query(_quality_sql())
def op6_quality_rules(spark, sf):
    judged = quality.apply_rules(table(spark, sf, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op7_decontaminate(spark, sf):
    found = decontaminate.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op8_pack_sequences(spark, sf):
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op9_warc_round_trip(spark, sf):
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    found = warc.round_trip(spark, table(spark, sf, "pages"))
    return found.select(
        F.nullif(number("record_id"), F.lit("")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.nullif(number("refers_to"), F.lit("")).cast("long").alias("refers_to"),
    )


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == HELD_OUT


def toxicity_model(spark: SparkSession, documents: DataFrame, sf: str) -> toxicity.ToxicityModel:
    return toxicity.fit(documents, table(spark, sf, "labels").where(~held_out()))


@query()
def op10_toxicity(spark, sf):
    documents = table(spark, sf, "documents")
    scored = toxicity.score_toxicity(documents, toxicity_model(spark, documents, sf), keep=["doc_id"])
    return scored.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted")
    )


@query()
def op11_simhash_groups(spark, sf):
    return simhash.simhash_groups(table(spark, sf, "documents"))


@query()
def op12_token_alignment(spark, sf):
    path = public_tokenizers.path
    return alignment.align(table(spark, sf, "documents"), path("byte_bpe_50k.json"), public_tokenizers.PATTERN, path("piece_bpe_32k.model"))


MERKLE_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Levels that the SQL twin unrolls, over rows of a source and over sources.
SQL_LEVELS, SQL_TOP_LEVELS = 7, 4


def _merkle_sql() -> str:
    def leaf(text):
        return "sha256(" + " || ".join(
            f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in [*MERKLE_FIELDS[:-1], text]
        ) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"""
    steps = []

    def tree(name: str, group: str, levels: int) -> None:
        """Tables name_0, .. of nodes (group, i, d, m nodes of the level) with the digests beside them in their run."""
        over = f"PARTITION BY {group}, i // 16 ORDER BY i ROWS BETWEEN"
        for k in range(levels):
            if k:
                steps.append(f"""{name}_{k} AS (SELECT {group}, i // 16 AS i, CASE WHEN max(m) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d,
                    (max(m) + 15) // 16 AS m FROM {name}_{k - 1} GROUP BY {group}, i // 16)""")
            steps.append(f"""{name}_path_{k} AS (SELECT {group}, i, m, coalesce(string_agg(d, '') OVER ({over} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                coalesce(string_agg(d, '') OVER ({over} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}_{k})""")

    steps.append(f"""leaves AS (SELECT doc_id, source, {leaf("text")} AS d,
        CASE WHEN ({crc}) % 5 = 0 THEN {leaf(lowered)} ELSE {leaf("text")} END AS told FROM documents)""")
    steps.append("""docs_0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS i,
        count(*) OVER (PARTITION BY source) AS m FROM leaves)""")
    tree("docs", "source", SQL_LEVELS)
    steps.append(f"""tops_0 AS (SELECT 0 AS one, source, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS m FROM docs_{SQL_LEVELS - 1})""")
    tree("tops", "one", SQL_TOP_LEVELS)
    joins = [f"JOIN docs_path_{k} p{k} ON p{k}.source IS NOT DISTINCT FROM t.source AND p{k}.i = t.i // {16 ** k}" for k in range(SQL_LEVELS)]
    joins += [f"JOIN tops_path_{k} q{k} ON q{k}.i = s.i // {16 ** k}" for k in range(SQL_TOP_LEVELS)]
    ways = [f"p{k}" for k in range(SQL_LEVELS)] + [f"q{k}" for k in range(SQL_TOP_LEVELS)]
    steps.append(f"""f_0 AS (SELECT t.doc_id, t.d AS leaf, s.d AS subroot, (SELECT d FROM tops_{SQL_TOP_LEVELS - 1}) AS root, t.told AS acc,
        {", ".join(f"{w}.l AS {w}l, {w}.r AS {w}r, {w}.m AS {w}m" for w in ways)}
        FROM docs_0 t JOIN tops_0 s ON s.source IS NOT DISTINCT FROM t.source {" ".join(joins)})""")
    for k, w in enumerate(ways):
        steps.append(f"f_{k + 1} AS (SELECT * REPLACE (CASE WHEN {w}m > 1 THEN sha256({w}l || acc || {w}r) ELSE acc END AS acc) FROM f_{k})")
    proof = " || ".join(f"{w}l || {w}r" for w in ways)
    return f"""WITH {", ".join(steps)}
SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, acc AS folded_root, acc = root AS verified FROM f_{len(ways)}"""


@query(_merkle_sql())
def op13_merkle_manifest(spark, sf):
    documents = table(spark, sf, "documents")
    values = [F.col(c) for c in MERKLE_FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    leaves = documents.select(
        F.col("source").alias("grp"), F.col("doc_id").alias("ord"), merkle.row_digest(values).alias("digest"),
        F.struct("doc_id", F.when(chosen, merkle.row_digest([*values[:-1], lowered])).alias("tampered")).alias("row"),
    )
    proved = merkle.prove(leaves)
    folded = proved.withColumn("folded_root", merkle.fold("path", F.coalesce("row.tampered", "leaf")))
    return folded.select(
        "row.doc_id", "leaf", "subroot", "root", merkle.proof_digest("path").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
