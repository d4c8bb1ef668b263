"""The registered queries of the subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, langid, lmscore, media, ngramjoin, pieces, pii, prefixtrie, seekstore, sharding, spelling, warc

#: Name of the public vocabulary file of the automaton; its folder is a parameter of the operator.
BYTE_VOCABULARY = "byte_bpe_50k.json"
#: Name of the tokenizer whose ids are stored, and the id that ends a document.
WORD_TOKENIZER, END_ID = "word_bpe_49k.json", 2
#: Name of the public model file of merge type.
PIECE_MODEL = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = seekstore.write_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), END_ID)
    return seekstore.id_digest(seekstore.read_ids(spark, manifest))


def op2_sampled_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(sharding.shard_by_bytes(_table(spark, sf_dir, "documents")))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(_table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    held_out = langid.held_out("doc_id", fold=1)
    scored = lmscore.score(documents, documents.where(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.links(_table(spark, sf_dir, "documents"), size=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    guessed = langid.fit_and_predict(_table(spark, sf_dir, "documents"))
    return guessed.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(pii.find(_table(spark, sf_dir, "documents")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write(warc.plan(_table(spark, sf_dir, "pages")))
    return warc.archive_digest(warc.read(spark, files))


def op11_piece_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(_table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_id_store, op2_sampled_sharding, op3_media_columns, op4_lm_scoring, op5_ngram_jaccard, op6_benchmark_decontamination, op7_bpe_automaton, op8_language_id, op9_pii, op10_warc, op11_piece_prefix_table, op12_prefix_trie, op13_spelling_variants)}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def _crc32(s: str) -> str:
    """The unsigned CRC-32 of a string's UTF-8 bytes, bit by bit."""
    h=f"hex(encode({s}))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({h}) // 2 + 1), lambda i: ('0x' || substr({h}, 2 * i - 1, 2))::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda y, k: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"


ORACLE_SQL: dict[str, str] = {
    "op5_ngram_jaccard": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS i FROM w)),
n AS (SELECT w.doc_id, count(s.sh) AS n_shingles FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
lk AS (SELECT a, b FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n_shingles + y.n_shingles - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, lk.b FROM reach r JOIN lk ON lk.a = r.b)
SELECT n.doc_id, n_shingles, component_id FROM n JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) USING (doc_id)""",
    "op6_benchmark_decontamination": rf"""WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
il AS (SELECT item_id, ws, least(13, len(ws)) AS size FROM iw WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS txt FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM il)),
sizes AS (SELECT DISTINCT size FROM win),
own AS (SELECT doc_id, size, i, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS txt FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM dw, sizes)),
hit AS (SELECT doc_id, i, own.size, item_id FROM own JOIN win ON own.size = win.size AND own.txt = win.txt),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hit), nh AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op10_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < keeper THEN keeper END AS refers_to FROM p LEFT JOIN k USING (payload_digest)""",
    "op12_prefix_trie": rf"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, count(*) AS own, {_crc32("c::VARCHAR")} % 6 AS h FROM t GROUP BY 1),
k AS (SELECT l.c, l.h, l.c - l.c % 100 AS base, least(l.h, coalesce(b.own, 0)) AS taken FROM l LEFT JOIN l b ON b.c = l.c - l.c % 100),
r AS (SELECT k.c, pos AS depth, role, text FROM k JOIN t ON t.c = k.base AND pos <= taken UNION ALL SELECT k.c, taken + pos - h, role, text FROM k JOIN t ON t.c = k.c AND pos > h),
p AS (SELECT c, depth, length(text) AS size, sha256(string_agg(length(role)::VARCHAR || ':' || role || length(text)::VARCHAR || ':' || text, '' ORDER BY depth) OVER (PARTITION BY c ORDER BY depth)) AS path FROM r
  UNION ALL SELECT c, 0, 0, '' FROM k),
ends AS (SELECT c, max(depth) AS last FROM p GROUP BY 1),
nodes AS (SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, first(size) AS size, coalesce(string_agg(CASE WHEN last = depth THEN c::VARCHAR END, ',' ORDER BY c), '') AS ids FROM p JOIN ends USING (c) GROUP BY 1, 2),
up AS (SELECT DISTINCT a.path, b.path AS parent FROM p a JOIN p b ON a.c = b.c AND b.depth = a.depth - 1),
kids AS (SELECT parent AS path, count(*) AS n_children FROM up GROUP BY 1),
below AS (SELECT DISTINCT a.path AS top, b.path FROM p a JOIN p b ON a.c = b.c AND b.depth >= a.depth),
sums AS (SELECT top AS path, count(*) FILTER (WHERE kids.path IS NULL) AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens FROM below JOIN nodes USING (path) LEFT JOIN kids USING (path) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(n.ids) AS ends_sha256
FROM nodes n JOIN sums USING (path) LEFT JOIN kids USING (path) LEFT JOIN up USING (path) LEFT JOIN nodes m ON m.path = up.parent""",
    "op13_spelling_variants": rf"""WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY 1, 2),
hashed AS (SELECT run, n, {_crc32("doc || ':' || run")} AS h FROM runs),
v AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
cut AS (SELECT DISTINCT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
pairs AS (SELECT a.word AS word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT cut.word, v.word, v.n FROM cut JOIN v ON cut.rest = v.word UNION SELECT v.word, cut.word, cut.n FROM cut JOIN v ON cut.rest = v.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM pairs GROUP BY 1),
named AS (SELECT word, n_near, top, min(other) AS other FROM best JOIN pairs USING (word) WHERE other_n = top GROUP BY 1, 2, 3),
found AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * v.n THEN other END AS form, CASE WHEN top >= 2 * v.n THEN top END AS form_n FROM v LEFT JOIN named USING (word)),
up AS (SELECT word, word AS root, 0 AS steps FROM found UNION ALL SELECT up.word, found.form, steps + 1 FROM up JOIN found ON found.word = up.root WHERE found.form IS NOT NULL)
SELECT found.word, form, arg_max(root, steps) AS root, n, n_near, form_n FROM found JOIN up USING (word) GROUP BY found.word, form, n, n_near, form_n""",
}
