"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lindero.llm import (
    bpe, chat, collocations, forest, huffman, langid, mixing, probminhash, quality,
    sharding, spelling, subspace, token_counts,
)
from lindero.llm.common import table

QUALITY_LIMIT = 0.3
TOKEN_LIMIT = 512

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_mixing(spark, sf):
    """Every document of the table with how much of it the mix takes."""
    planned = mixing.plan_copies(table(spark, sf, "documents"))
    return planned.select("doc_id", "size", "source_size", "target",
                          (F.col("size") * F.col("copies")).cast("bigint").alias("taken"))


ORACLE["op3_mixing"] = r"""
WITH d AS (SELECT doc_id, source,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS top,
             (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight
      FROM s),
c AS (SELECT *, sum(source_size) OVER () AS total,
             sum(top) OVER o - top AS taken, sum(weight) OVER () - (sum(weight) OVER o - weight)
                 AS open
      FROM w WINDOW o AS (ORDER BY top::DOUBLE / weight, encode(source) ROWS UNBOUNDED PRECEDING)),
-- the first source, in order of top over weight, that its share does not fill: all before are full
f AS (SELECT total - taken AS rest, open FROM c
      WHERE top::DOUBLE > weight::DOUBLE * (total - taken)::DOUBLE / open::DOUBLE
      ORDER BY taken, open DESC LIMIT 1),
t AS (SELECT w.*, CASE WHEN f.open IS NULL
                         OR top::DOUBLE <= weight::DOUBLE * f.rest::DOUBLE / f.open::DOUBLE
                       THEN top::DOUBLE
                       ELSE weight::DOUBLE * f.rest::DOUBLE / f.open::DOUBLE END AS target
      FROM w LEFT JOIN f ON true),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
             ('0x' || substr(md5('mix|' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT
                 / 4294967296.0::DOUBLE AS chance
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT
           AS taken
FROM r
"""


@query
def op5_sharding(spark, sf):
    """Every document with its shard and place under the law of near-equal bytes."""
    placed = sharding.shard(table(spark, sf, "documents"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return placed.select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_language_id(spark, sf):
    """Predicted language of every document; documents of remainder 2 are held out."""
    docs = table(spark, sf, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    network = langid.learn(docs, remainder != 2)
    found = langid.identify(docs.select("doc_id", "text"), network)
    return found.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"),
                        "lang_pred", F.col("lang_score").alias("score"))


@query
def op9_bpe(spark, sf):
    """Every document encoded by the ranks and decoded again."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(encoded, ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_quality(spark, sf):
    """Quality score of every document; documents of remainder 0 are held out."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = quality.learn(docs, labels, remainder != 0)
    found = quality.score(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.when(F.col("quality_score") >= QUALITY_LIMIT, 1).otherwise(0).alias("predicted"))


@query
def op4_minhash(spark, sf):
    """Every document with its class of copies and its group of near duplicates."""
    return probminhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op8_huffman(spark, sf):
    """Every document's ids, written in blocks of Huffman code and read back from the files."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    read = huffman.round_trip(table(spark, sf, "documents"), path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op6_neighbours(spark, sf):
    """The five nearest of every vector whose id is divisible by 50."""
    return forest.search(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op1_subspace(spark, sf):
    """Every vector with its number of links and its group of near duplicates."""
    return subspace.near_vectors(table(spark, sf, "embeddings"))


@query
def op11_token_counts(spark, sf):
    """Bytes and tokens of every document, and whether it exceeds 512 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = token_counts.count_tokens(table(spark, sf, "documents").select("doc_id", "text"), path)
    return counted.select("doc_id", "n_bytes", "n_tokens",
                          (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query
def op13_spelling(spark, sf):
    """Every word with its near words, its form and the root its forms lead to."""
    return spelling.variants(table(spark, sf, "documents")).select(
        "word", "form", "root", "n", "n_near", "form_n")


# crc32 byte by byte over a table of 256 entries; near pairs by equal rests after one deletion.
ORACLE["op13_spelling"] = r"""
WITH RECURSIVE steps AS (
  SELECT i AS i, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1
  FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (SELECT doc_id, lower_run AS run, count(*) AS n FROM (
           SELECT doc_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[a-z\x{C0}-\x{FF}]+')) AS lower_run FROM documents)
         WHERE length(lower_run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
             regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, 'null') || ':' || run)), '..'),
             lambda x: ('0x' || x)::BIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
           FROM runs, crc),
made AS (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, (h % length(run))::BIGINT)
                       || substring(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n
         FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 5
      GROUP BY word HAVING sum(n) >= 3),
d AS (SELECT word, n, p, substring(word, 1, p - 1) || substring(word, p + 1) AS rest
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)),
pairs AS (SELECT a.word AS word, b.word AS near, b.n AS near_n
          FROM d a JOIN d b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
          UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word
          UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS form_n,
                first(near ORDER BY near_n DESC, encode(near)) AS form FROM pairs GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
             CASE WHEN form_n >= 2 * v.n THEN form END AS form,
             CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n
      FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS next FROM f
          UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""


@query
def op12_collocations(spark, sf):
    """The first 2000 collocations of each language."""
    found = collocations.collocations(table(spark, sf, "documents"))
    longs = [F.col(c).cast("bigint").alias(c) for c in ("rank", "a", "l", "r", "n", "score")]
    return found.select("lang", "phrase", *longs)


ORACLE["op12_collocations"] = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(
             text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
           FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2),
                             lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
      FROM w, range(1, 6) r(k)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut
      FROM f WHERE k > 1),
s AS (SELECT c.lang, c.k, c.phrase, c.a, c.cut, l.a AS l, r.a AS r, n.n,
             (1000 * c.a * n.n) // (l.a * r.a) AS score
      FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.cut], ' ')
             JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.cut + 1:], ' ')
             JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
x AS (SELECT b.* FROM b WHERE NOT EXISTS (
        SELECT 1 FROM f WHERE f.lang = b.lang AND f.k > b.k AND 100 * f.a >= 100 * b.a
          AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' '))),
o AS (SELECT *, row_number() OVER (PARTITION BY lang
                                   ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM x)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
       n::BIGINT AS n, score::BIGINT AS score
FROM o WHERE rank <= 2000
"""


@query
def op2_chat(spark, sf):
    """Every conversation, formatted and read back, and one that holds control strings."""
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(odd))
    turns = given.union(extra).withColumn("parts", chat.text_parts(F.col("text")))
    done = chat.format_chats(turns).select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss")).alias("loss"))
    lines = F.concat_ws("", F.transform("turns", lambda t: F.concat(
        t.role, F.lit("\n"), t.text, F.lit("\n"))))
    return done.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


ORACLE["op2_chat"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), ''
                        ORDER BY turn NULLS FIRST, role, text) AS lines,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                      FILTER (WHERE role = 'assistant'), '') AS loss,
             sum(length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g'))
                 + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g'))
                 + length('<turn >') + length('</turn>') + 1)::BIGINT AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT conv_id::BIGINT AS conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars
FROM g
"""
