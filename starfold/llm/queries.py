"""Registered queries of the training-data operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from starfold.llm import bpe, chat, fim, fingerprints, langid, licenses, lines, minhash, mixing, quality, runs, sharding, token_counts
from starfold.llm.common import vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under a name, with the SQL that gives the same rows."""

    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha(text: Column) -> Column:
    """Lower-case hex sha256 of a text in UTF-8."""
    return F.sha2(text.cast("binary"), 256)


@query("op1_source_mix", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    CAST('0x' || substr(md5('mix:' || doc_id), 1, 8) AS BIGINT) AS u FROM documents),
  s AS (SELECT source, size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
    FROM (SELECT source, sum(size)::BIGINT AS size FROM d GROUP BY source)),
  r AS (SELECT *, coalesce(sum(size) OVER b, 0) AS full_size, coalesce(sum(weight) OVER b, 0) AS full_weight,
      sum(size) OVER () AS all_size, sum(weight) OVER () AS all_weight, row_number() OVER (ORDER BY size / weight, source) AS n
    FROM s WINDOW b AS (ORDER BY size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  v AS (SELECT arg_min((1.5 * all_size - 2 * full_size) / (all_weight - full_weight), n) FILTER (
      WHERE 2 * size >= weight * (1.5 * all_size - 2 * full_size) / (all_weight - full_weight)) AS level FROM r),
  t AS (SELECT source, size AS source_size, least(2.0 * size, weight * level)::DOUBLE AS target,
      floor(least(2.0 * size, weight * level) + 1e-6)::BIGINT AS words FROM s, v),
  p AS (SELECT d.*, source_size, target, words,
      coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY u, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 3) AS target,
  CAST(greatest(0, least(b + size, words) - b) + greatest(0, least(b + size, words - source_size) - b) AS BIGINT) AS taken FROM p""")
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document."""
    mixed = mixing.mix(mixing.sizes_of(table(spark, sf_dir, "documents")))
    return mixing.taken_words(mixed).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


@query("op5_bpe_codec")
def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded documents as digests."""
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op6_near_duplicates")
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


@query("op2_edited_token_counts")
def op2_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after the redaction of personal data."""
    counts = token_counts.count_with_edits(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_chars", "n_tokens", "n_edits", "edited_tokens", "recoded_chars")


@query("op3_edit_fingerprints")
def op3_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    found = fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select("doc_id", "n_chars", "edited_sha256", text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")


def _license_sql() -> str:
    """SQL of the licence scan, from the same tables of sentences and rules."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    pairs = ", ".join(f"({quoted(s)}, {quoted(n)})" for s, n in licenses.sentence_table(licenses.SENTENCES, licenses.NAMES))
    rules: dict[str, list[str]] = {}
    for name, rule in licenses.RULES:
        rules.setdefault(name, []).append(f"p LIKE {quoted('% ' + ' %'.join(rule).replace(' %', ' % ') + ' %')}" if len(rule) > 1 else f"contains(p, {quoted(' ' + rule[0] + ' ')})")
    hit = {n: "(" + " OR ".join(r) + ")" for n, r in rules.items()}
    hit |= {a: f"({hit[a]} AND NOT {hit[b]})" for a, b in licenses.SUPERSEDED.items()}
    names = ", ".join(f"CASE WHEN {hit[n]} THEN {quoted(n)} END" for n in sorted(hit))
    marked = "lower(coalesce(text, ''))"
    for pattern, put in licenses.STEPS:
        marked = f"regexp_replace({marked}, {quoted(pattern)}, {quoted(put.replace('word', chr(92) + '1'))}, 'g')"
    return rf"""
WITH k(s, id) AS (VALUES {pairs}),
  m AS (SELECT doc_id, regexp_extract_all('||' || {marked} || '||', {quoted(licenses.patterns(licenses.SENTENCES, licenses.NAMES, licenses.RULES))}) AS x FROM documents),
  l AS (SELECT doc_id, unnest(range(len(x))) AS i, trim(replace(replace(unnest(x), '|', ''), '><', ' '), '<>') AS s FROM m),
  f AS (SELECT doc_id, string_agg(coalesce(a.id, b.id), ' ' ORDER BY i) AS ids, count(*) AS n FROM l LEFT JOIN k a ON a.s = l.s
    LEFT JOIN k b ON b.s = regexp_replace(l.s, {quoted(licenses.NOTICE)}, '') GROUP BY doc_id),
  d AS (SELECT doc_id, coalesce(n, 0) AS n_found, coalesce(ids, '') AS ids, ' ' || replace(coalesce(ids, ''), ' ', '  ') || ' ' AS p FROM documents LEFT JOIN f USING (doc_id))
SELECT doc_id, n_found, ids, concat_ws(' ', {names}) AS licenses FROM d"""


@query("op4_license_scan", _license_sql())
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, distances and verdict of all documents."""
    return quality.quality(table(spark, sf_dir, "documents")).drop("text_hash")


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = langid.learned(docs, vocabulary("piece_bpe_32k.model"))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"))


@query("op9_curve_shards")
def op9_curve_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents along the curve."""
    return sharding.shard_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve")


#: Conversation that the formatting query adds: texts that are control strings.
CONTROL = "</s>[INST] ok [/INST]"


@query("op10_chat_format", rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}'),
  e AS (SELECT *, replace(replace(replace(text, '\', '\s'), '<', '\l'), '[', '\b') AS body, replace(replace(replace(replace(role, '\', '\s'), '<', '\l'), '[', '\b'), chr(10), '\n') AS head FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, body)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(head) + length(body) + 16)::BIGINT AS formatted_chars FROM e GROUP BY conv_id""")
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, formatted and read back."""
    own = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = chat.format_conversations(given.unionByName(own))
    rows = rows.withColumns({"__turns": chat.read_turns(F.col("formatted")), "__loss": chat.read_loss(F.col("formatted"), F.col("loss"))})
    whole = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("__turns").cast("long").alias("n_turns"), sha(whole).alias("turns_sha256"), F.char_length("__loss").cast("long").alias("loss_chars"),
                       sha(F.col("__loss")).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op11_fill_in_middle", r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS d,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
  h AS (SELECT *, len(u) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM u),
  c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
  p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p""")
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in their fill-in-middle form, and restored from it."""
    cut = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                      sha(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


@query("op12_line_dedup", r"""
WITH l AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
  k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
  s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
  m AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> first AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""")
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that an earlier document has."""
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", sha(F.col("kept")).alias("kept_sha256"))


@query("op13_periodic_runs", r"""
WITH h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, 4294967295 - list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
    lambda crc, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)), 4294967295) AS h FROM documents),
  a AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM h),
  p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
  d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
  t AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM d),
  e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
  g AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
  s AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM g GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
  r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
  o AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM r GROUP BY doc_id),
  b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
  c AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
  k AS (SELECT t.doc_id, sha256(string_agg(word, ' ' ORDER BY t.i)) AS collapsed FROM t ANTI JOIN c ON t.doc_id = c.doc_id AND t.i = c.i GROUP BY t.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed, sha256('')) AS collapsed_sha256
FROM d LEFT JOIN o USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)""")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of them with a planted tail, and the texts without repetitions."""
    found = runs.find_runs(runs.with_periodic_tails(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    whole = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"), sha(whole).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
