"""Registered queries of the operators and the SQL they are compared with."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkgauge.llm import alignment, ann, bpe, content_sort, multiset_hash, packing, secrets, shards, simhash, toxicity, url_filter, variants, warc
from sparkgauge.llm.common import scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(query):
    QUERIES[query.__name__] = query
    return query


@register
def op1_bpe_automaton(spark: SparkSession, sf: str) -> DataFrame:
    """Every text encoded and decoded by the merge automaton, as digests."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    fields = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    return bpe.bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"], then=bpe.digests, then_fields=fields)


#: Rules of the query: (rule, verdict).
URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


@register
def op2_url_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict of the longest rule that fits each page's url."""
    index = url_filter.build_index(spark.createDataFrame(list(URL_RULES), "rule string, verdict string"))
    pages = table(spark, sf, "pages").select("page_id", "url")
    return url_filter.judge(pages, index, keep=["page_id"])


SQL["op2_url_digests"] = f"""
WITH rules(rule, verdict) AS (VALUES {", ".join(map(repr, URL_RULES))}),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT p.page_id, p.host, p.path, r.rule, r.verdict,
  row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC, strpos(r.rule, '/') DESC) AS nth
  FROM parts p LEFT JOIN rules r ON (p.host = split_part(r.rule, '/', 1) OR p.host LIKE '%.' || split_part(r.rule, '/', 1))
   AND starts_with(p.path, substr(r.rule, strpos(r.rule, '/'))))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE nth = 1"""


@register
def op4_warc_source(spark: SparkSession, sf: str) -> DataFrame:
    """Pages written as WARC records, equal payloads once, and read back with their digests checked."""
    path = scratch(spark, "warc")
    warc.write_pages(table(spark, sf, "pages"), path)
    records = warc.read_archives(spark, path, verify=True)
    number = lambda name: F.regexp_extract(name, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    size = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    return records.select(number("record_id").alias("page_id"), size.alias("payload_bytes"), "payload_digest", "record_type",
                          number("refers_to").alias("refers_to"))


# SHA-1 in base 32: eight groups of five hex digits, four characters each.
SQL["op4_warc_source"] = """
WITH told AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS digest, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, payload_bytes, list_reduce(list_transform(range(0, 8), lambda g: list_reduce(list_transform(range(0, 4), lambda c:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(digest, g::INT * 5 + 1, 5))::BIGINT >> (15 - 5 * c::INT)) & 31)::INT + 1, 1)), lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM told"""


@register
def op6_simhash_gray(spark: SparkSession, sf: str) -> DataFrame:
    """SimHash fingerprints and the components of those at most three bits apart."""
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


@register
def op5_histogram_shards(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    dealt = shards.histogram_shards(table(spark, sf, "documents").select("doc_id", "text"))
    return dealt.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"),
                        "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@register
def op8_multiset_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Multiset fingerprints of all texts and their edited texts, with likenesses."""
    made = multiset_hash.edited_fingerprints(table(spark, sf, "documents"))
    vector, edited, after = F.col("vector"), F.col("edited_vector"), F.col("next_vector")
    return made.select("doc_id", "n_chars", "edited_sha256", multiset_hash.as_text(vector).alias("fingerprint"),
                       multiset_hash.as_text(edited).alias("edited_fingerprint"),
                       multiset_hash.likeness(vector, edited).alias("near_edited"), multiset_hash.likeness(vector, after).alias("near_next"))


@register
def op7_pattern_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as token pieces packed into sequences of at most 2048 tokens."""
    docs = table(spark, sf, "documents")
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@register
def op9_adaptive_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 largest inner products of every 20th vector against all others."""
    return ann.search(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@register
def op3_secret_field(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in every text by fixed patterns and a conditional random field."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.fit(docs), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in secrets.KINDS],
                        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


#: A score from here on is toxic.
TOXIC_FROM = 0.3


@register
def op10_toxic_grammar(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of every text by the weighted pattern grammar."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")), keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


@register
def op11_content_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the row that stays of its equal texts."""
    return content_sort.exact_duplicates(table(spark, sf, "documents").select("doc_id", "text"))


SQL["op11_content_sort"] = """
WITH told AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER best = 1 AS kept, sha256(body) AS text_sha256
FROM told WINDOW best AS (PARTITION BY body ORDER BY chars DESC, doc_id NULLS LAST)"""


def _misspelled(doc_id) -> Callable[[str], str]:
    """One in 97 of a document's words, by their checksum, without one of its code points."""
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())

    def spelled(run: str) -> str:
        h = zlib.crc32(run.encode(), head)
        at = h % len(run)
        return run if h % 97 else run[:at] + run[at + 1:]

    return spelled


@register
def op12_gram_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Words of all documents with their near words counted, their form and the root of their forms."""
    words = variants.word_counts(table(spark, sf, "documents"), spelling=_misspelled)
    return variants.variant_groups(words)


# crc32 by its table of 256 remainders; near words meet in what is left of one of them, or of both, without one code point.
SQL["op12_gram_variants"] = """
WITH RECURSIVE bits(b, step, r) AS (SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, step + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END FROM bits WHERE step < 8),
rests AS (SELECT list(r ORDER BY b) AS t FROM bits WHERE step = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS tagged, run, count(*) AS n FROM runs GROUP BY ALL),
coded AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(tagged) + 1), lambda i: ('0x' || substr(hex(encode(tagged)), 2 * i - 1, 2))::BIGINT)),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM counted, rests),
spelled AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM coded),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelled GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
less AS (SELECT word, n, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT a.word, a.n, w.word, w.n FROM less a JOIN words w ON a.rest = w.word
  UNION SELECT w.word, w.n, a.word, a.n FROM less a JOIN words w ON a.rest = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM pairs GROUP BY word),
told AS (SELECT w.word, CASE WHEN form_n >= 2 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain(word, last_form, form) AS (SELECT word, word, form FROM told UNION ALL SELECT c.word, t.word, t.form FROM chain c JOIN told t ON c.form = t.word)
SELECT told.word, told.form, chain.last_form AS root, n, n_near, form_n FROM told JOIN chain ON chain.word = told.word AND chain.form IS NULL"""


@register
def op13_csr_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens over every text."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return alignment.align_tokenizers(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@register
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus pipeline: toxicity, near duplicates, secrets, packing."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
