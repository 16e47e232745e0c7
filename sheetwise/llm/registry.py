"""Registered queries of this subpackage, with DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm import (bpe_automaton, chat_format, conversation_trie, decontaminate, html_extract, language_id,
                           ngram_join, packing, phrases, suffix_dedup, token_counts, warc)
from sheetwise.llm.common import shared_path, table
from sheetwise.llm.exact_dedup import exact_dedup

BPE_FILE = "byte_bpe_50k.json"
TOKEN_LIMIT = 512

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


#: Lower-cased (A-Z) words of a table's texts, as lists, in DuckDB SQL.
_WORDS_SQL = r"""
  SELECT {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x20\x09-\x0D]+') AS ws FROM {table}
"""
_DOC_WORDS = _WORDS_SQL.format(id="doc_id", table="documents")


def tokenizer_path(name: str = BPE_FILE) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op1_html_extract")
def q_op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by wrappers induced for every host."""
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@register("op2_token_counts")
def q_op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token count of every whole document, from the prefix counts of its words."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    counted = token_counts.count_tokens(docs, tokenizer_path(), drop_text=True)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@register("op3_ngram_jaccard_join", sql=f"""
WITH RECURSIVE w AS ({_DOC_WORDS}),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS sh
      FROM w, unnest(generate_series(1, greatest(1, len(ws) - 3))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
""")
def q_op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets reach Jaccard 0.85, by PartEnum."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op4_decontamination", sql=f"""
WITH d AS ({_DOC_WORDS}), b AS ({_WORDS_SQL.format(id="item_id", table="benchmark")}),
ds AS (SELECT doc_id, len(ws) AS n, i - 1 AS place, array_to_string(ws[i:i + 4], ' ') AS sh
       FROM d, unnest(generate_series(1, len(ws) - 4)) AS t(i)),
bs AS (SELECT item_id, len(ws) AS n, array_to_string(ws[i:i + 4], ' ') AS sh, count(*) AS c
       FROM b, unnest(generate_series(1, len(ws) - 4)) AS t(i) GROUP BY ALL),
hits AS (SELECT DISTINCT doc_id, item_id, ds.n AS dn, bs.n AS bn, place FROM ds JOIN bs USING (sh)),
starts AS (SELECT DISTINCT doc_id, item_id, dn, bn, least(greatest(place - k, 0), greatest(dn - bn, 0)) AS p
           FROM hits, unnest(generate_series(0, bn - 5)) AS t(k)),
common AS (SELECT doc_id, item_id, dn, bn, p, sh, c, count(*) AS cw
           FROM starts JOIN ds USING (doc_id) JOIN bs USING (item_id, sh)
           WHERE place BETWEEN p AND least(p + bn, dn) - 5 GROUP BY ALL),
sims AS (SELECT doc_id, item_id, p, least(bn, dn - p) AS words, sum(least(c, cw)) AS low,
                (bn - 4) + (least(bn, dn - p) - 4) AS total FROM common GROUP BY ALL),
best AS (SELECT *, low / (total - low) AS similarity,
                row_number() OVER (PARTITION BY doc_id, item_id ORDER BY low / (total - low) DESC, p) AS r FROM sims)
SELECT doc_id, item_id, CAST(similarity AS DOUBLE) AS similarity, CAST(p AS INTEGER) AS first_word, CAST(words AS INTEGER) AS n_words
FROM best WHERE r = 1 AND 5 * low >= 4 * (total - low)
""")
def q_op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item with a window of weighted five-word similarity 0.8."""
    return decontaminate.find_contamination(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@register("op5_language_id")
def q_op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document by PPM code length; a quarter of the ids is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    got = language_id.learn_and_identify(spark, docs, drop_text=True)
    return got.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@register("op6_exact_dedup", sql=r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM n
WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""")
def q_op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-pass Bloom exact dedup of every document: which row of equal texts stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register("op7_chat_format", sql=r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, length(role) + length(text) + CAST(list_sum(list_transform(
    ['\', '<|', '|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>'],
    lambda c: (length(role) - length(replace(role, c, '')) + length(text) - length(replace(text, c, ''))) // length(c)
    )) AS BIGINT) AS n
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) + 24 * count(*) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
""")
def q_op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one full of control strings, formatted and read back."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], talk.schema)
    formatted = chat_format.format_conversations(talk.unionByName(extra))
    back = chat_format.read_back(formatted)
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@register("op8_bpe_encode_decode")
def q_op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded by the tokenization automaton and decoded again."""
    path = tokenizer_path()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_automaton.encode_and_decode(docs, path, drop_text=True)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register("op9_suffix_array_dedup", sql=f"""
WITH w AS ({_DOC_WORDS}),
r AS (SELECT doc_id, i AS s, array_to_string(ws[i + 1:i + 50], ' ') AS run
      FROM w, unnest(generate_series(0, len(ws) - 50)) AS t(i)),
k AS (SELECT run, min(doc_id) AS lo FROM r GROUP BY run HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT doc_id, s, lo, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS fresh
      FROM r JOIN k USING (run)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS passage FROM m)
SELECT doc_id, CAST(min(s) AS INTEGER) AS first_word, CAST(max(s) + 50 - min(s) AS INTEGER) AS n_words, min(lo) AS first_id
FROM g GROUP BY doc_id, passage
""")
def q_op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 or more words that occur in several documents, by a sparse suffix array."""
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op10_warc", sql=r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
""")
def q_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as seekable WARC bundles, equal payloads as revisits, and read back."""
    folder = shared_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return warc.read_archives(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op12_packing")
def q_op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens, by first-fit decreasing in randomised groups."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = packing.encode_documents(docs, tokenizer_path("word_bpe_49k.json"))
    return packing.pack(encoded).drop("row_key")


@register("op13_phrase_collocations", sql=r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
      FROM w, unnest(generate_series(1, 4)) AS s(k), unnest(generate_series(1, len(ws) - k + 1)) AS t(i)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, j AS cut, x.f AS l, y.f AS r, 2000000::HUGEINT * c.f // (x.f + y.f) AS score
  FROM f AS c, unnest(generate_series(1, c.k - 1)) AS t(j)
  JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(string_split(c.phrase, ' ')[1:j], ' ')
  JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(string_split(c.phrase, ' ')[j + 1:], ' ')
  WHERE c.k > 1),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS i FROM cuts),
kept AS (
  SELECT * FROM best AS b WHERE i = 1 AND NOT EXISTS (
    SELECT 1 FROM f AS o WHERE o.lang = b.lang AND o.k > b.k AND 100::HUGEINT * o.f >= 80 * b.a
      AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""")
def q_op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of every language, by stripes over all documents."""
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


@register("op11_conversation_trie", sql=r"""
WITH said AS (
  SELECT conv_id, list(sha256(coalesce(role, '') || chr(31) || coalesce(text, '')) || ':'
                       || len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
      lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 AS h
  FROM said),
seqs AS (SELECT a.conv_id, list_concat(coalesce(b.ts[1:a.h], []), a.ts[a.h + 1:]) AS ts
         FROM h AS a LEFT JOIN said AS b ON b.conv_id = a.conv_id - a.conv_id % 20),
p AS (SELECT conv_id, d, ts[1:d] AS path, d = len(ts) AS ends FROM seqs, unnest(generate_series(0, len(ts))) AS s(d)),
n AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
      FROM p GROUP BY d, path),
k AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
s AS (SELECT path[1:j] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
             CAST(sum(CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * CAST(string_split(path[d], ':')[2] AS BIGINT) END) AS BIGINT) AS saved_tokens
      FROM m, unnest(generate_series(0, d)) AS t(j) GROUP BY 1)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256
FROM m JOIN s ON s.path = m.path LEFT JOIN n AS u ON m.d > 0 AND u.path = m.path[1:m.d - 1]
""")
def q_op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt to share openings."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_trie.prefix_trie(conversation_trie.rebuilt(talk)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
