"""The operators of this subpackage as registered queries, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.alignment import align_tokenizers
from ledgerlens.llm.ann import nearest
from ledgerlens.llm.common import Scratch, table
from ledgerlens.llm.exact_dedup import exact_dedup
from ledgerlens.llm.line_dedup import frequent_line_dedup
from ledgerlens.llm.packing import pack_documents
from ledgerlens.llm.quality import BASE, fit_quality, judge_quality
from ledgerlens.llm.reshard import even_capacities, reshard
from ledgerlens.llm.segmentation import n_best_pieces
from ledgerlens.llm.simhash import simhash_components
from ledgerlens.llm.spelling import spelling_variants, word_counts
from ledgerlens.llm.suffix_dedup import suffix_dedup
from ledgerlens.llm.url_filter import Rule, canonical_url, judge_urls
from ledgerlens.llm.warc import mark_revisits, read_archives, write_archives
from ledgerlens.session import new_path


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return judge_quality(docs, model).select("doc_id", *BASE, "base_failed", "kept", "anomaly")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, k=10)


def op4_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From six shards by source, one of which holds a third of all rows, to eight of equal bytes."""
    old = F.pmod(F.xxhash64("source"), F.lit(6))
    done = reshard(table(spark, sf_dir, "documents"), old, 6, lambda total: even_capacities(total, 8))
    folder = new_path(spark, "shards")
    done.write(folder)
    fields = "doc_id bigint, text string, size bigint, old_shard int, slot bigint, shard int"
    written = spark.read.schema(fields).parquet(folder) if done.affected else done.placed
    if 0 < len(done.affected) < 8:
        # Shards that nothing enters or leaves stay as they are.
        written = written.unionByName(done.placed.where(~F.col("shard").isin(done.affected)))
    return written.select(*_shard_columns())


def _shard_columns() -> list:
    text = F.coalesce("text", F.lit(""))
    return [
        F.col("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("bytes").alias("law"), F.col("shard"), F.col("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("old_shard"),
    ]


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# The rules of the contract.
URL_RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: canonical URLs that stand for two pages or more, as left by a crawler running in circles."""
    pages = table(spark, sf_dir, "pages")
    repeated = (
        pages.groupBy(canonical_url(F.col("url")).alias("_page"))
        .agg(F.count(F.lit(1)).alias("_pages"), F.min("url").alias("url"))
        .where("_pages >= 2")
    )
    return judge_urls(pages, repeated.select("url"), URL_RULES)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op8_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every text, and what they decode to."""
    model = tokenizer_path("piece_bpe_32k.model")
    pieces = n_best_pieces(table(spark, sf_dir, "documents"), model, n=4, decoded=True)
    return pieces.select(
        "doc_id", "rank", "score", (F.octet_length("ids") / 4).cast("bigint").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"), F.crc32("text").alias("text_crc32"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, folder = Scratch(spark, "warc"), new_path(spark, "archives")
    files, _ = scratch.save(write_archives(mark_revisits(table(spark, sf_dir, "pages"), min_bytes=0), folder))
    records = read_archives(spark, files, folder)
    found, _ = scratch.save(records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    scratch.drop(folder)
    return found


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = frequent_line_dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return align_tokenizers(table(spark, sf_dir, "documents"), *paths).documents


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents")))


OP10_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT keyed.*, frequent.k IS NOT NULL AS dropped FROM keyed LEFT JOIN frequent USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP6_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '&'),
                               lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND NOT starts_with(p, 'ref='))) AS query
  FROM cut
), canonical AS (
  SELECT page_id, host, path,
         CASE WHEN host = '' THEN '' ELSE host || rtrim(path, '/') ||
           CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS page
  FROM parts
), repeated AS (
  SELECT page FROM canonical WHERE page <> '' GROUP BY page HAVING count(*) >= 2
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM canonical
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN page IN (SELECT page FROM repeated) THEN 'block' ELSE 'allow' END AS verdict,
       rule IS NULL AND page IN (SELECT page FROM repeated) AS listed
FROM ruled
"""

OP11_SQL = """
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY norm)
"""

# The CRC-32 of a run goes byte by byte over a table of 256 remainders; near words share what is left without one letter.
OP13_SQL = """
WITH RECURSIVE remainders AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{5,}')) AS run FROM documents)
  GROUP BY ALL
), bytes AS (
  SELECT low, times, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || low, ''),
           lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END)) AS b
  FROM runs
), hashed AS (
  SELECT low, times, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT)) AS h
  FROM bytes, remainders
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN low[:h % length(low)] || low[h % length(low) + 2:] ELSE low END AS word, sum(times)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(times) >= 3
), shorter AS (
  SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form,
         CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), steps AS (
  SELECT word, word AS root, 0 AS depth FROM formed
  UNION ALL
  SELECT steps.word, formed.form, depth + 1 FROM steps JOIN formed ON steps.root = formed.word WHERE formed.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(root, depth) AS root FROM steps GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_nearest": op3_nearest,
    "op4_reshard": op4_reshard,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_packing": op7_packing,
    "op8_segmentation": op8_segmentation,
    "op9_warc": op9_warc,
    "op10_line_dedup": op10_line_dedup,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_alignment": op12_alignment,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {
    "op6_url_filter": OP6_SQL,
    "op10_line_dedup": OP10_SQL,
    "op11_exact_dedup": OP11_SQL,
    "op13_spelling": OP13_SQL,
}
