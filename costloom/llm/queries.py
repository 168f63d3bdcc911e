"""One registered query per operator, over whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from costloom.llm import ann, bpe, chat, decontam, licenses, merkle, mixing, neardup, quality, ranked, secretscan, toxicity, urlfilter

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
# Ranked words for guess costs.
VOCABULARIES = [public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against rules and block list in one sorted digest array."""
    return urlfilter.judge_pages(_table(spark, sf_dir, "pages"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every fiftieth, by multiprobe hashing and exact reranking."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    trip = bpe.round_trip(spark, F.col("text"), RANKS, public_tokenizers.PATTERN)
    return _table(spark, sf_dir, "documents").select("doc_id", trip.alias("t")).select("doc_id", "t.n_tokens", "t.ids_sha256", "t.decoded_sha256")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 2-word shingle sets are 80 % alike."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secretscan.scan_documents(_table(spark, sf_dir, "documents"), VOCABULARIES)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the line CRF's verdict for every document."""
    docs = _table(spark, sf_dir, "documents")
    return quality.judge_documents(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its examples."""
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat.digests(chat.examples(turns.unionByName(planted)))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License texts in every document."""
    found = licenses.scan_documents(_table(spark, sf_dir, "documents"))
    span = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"), F.format_number(m["coverage"], 3)))
    return found.select("doc_id", "n_matches", "licenses", F.array_join(span, ",").alias("spans"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned without the held-out fifth of the labels."""
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in passages of the benchmark."""
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document proven against the root of the manifest, a seventh of them after tampering."""
    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.verify_documents(_table(spark, sf_dir, "documents"), marked)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_byte_level_bpe": op3_byte_level_bpe,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_secret_scans": op5_secret_scans,
    "op6_quality_rules": op6_quality_rules,
    "op7_source_mix": op7_source_mix,
    "op8_chat_format": op8_chat_format,
    "op9_license_scans": op9_license_scans,
    "op10_toxicity": op10_toxicity,
    "op11_benchmark_decontamination": op11_benchmark_decontamination,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_ranked_search": op13_ranked_search,
}
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _op1_sql() -> str:
    entries = ", ".join(f"('{e.text}', '{e.verdict}', {str(e.is_rule).lower()})" for e in urlfilter.entries_of())
    return f"""WITH entries(entry, verdict, is_rule) AS (VALUES {entries}),
      split AS (SELECT *, substr(entry, 1, strpos(entry, '/') - 1) AS h, substr(entry, strpos(entry, '/')) AS p FROM entries),
      cut AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
      urls AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_CAPITALS}', '{_CAPITALS.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
      best AS (SELECT n, arg_max({{'entry': entry, 'verdict': verdict, 'is_rule': is_rule}}, (is_rule, length(entry), length(h), verdict = 'block')) AS b
        FROM urls JOIN split ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
      SELECT page_id, host, path, CASE WHEN b.is_rule THEN b.entry END AS rule, coalesce(b.verdict, 'allow') AS verdict, CASE WHEN NOT b.is_rule THEN b.entry END AS listed
      FROM urls LEFT JOIN best USING (n)"""


def _op8_sql() -> str:
    chars = lambda c: f"length(regexp_replace({c}, '{chat._INSIDE}', '\\1\\\\\\2\\3', 'g'))"
    marks = len(chat.TURN + chat.BODY + chat.END)
    said = "'</s>[INST] ok [/INST]'"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', {said}), (-7, 1, 'assistant', {said})),
      n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS c FROM t),
      p AS (SELECT *, sum({marks} + {chars('role')} + {chars('text')}) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n)
      SELECT conv_id, max(c) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{chat.ASSISTANT}'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = '{chat.ASSISTANT}'), '')) AS loss_sha256,
        CAST(sum(upto) FILTER (WHERE role = '{chat.ASSISTANT}' OR i = c) AS BIGINT) AS formatted_chars FROM p GROUP BY conv_id"""


def _terms_sql(text: str) -> str:
    low = f"translate(coalesce({text}, ''), '{_CAPITALS}', '{_CAPITALS.lower()}')"
    return f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _op11_sql() -> str:
    span = decontam.SPAN
    return f"""WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_terms_sql('text')} AS w, least(len(w), {span}) AS k FROM benchmark),
      windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM items WHERE k > 0)),
      lengths AS (SELECT DISTINCT k FROM windows),
      docs AS (SELECT row_number() OVER () AS r, doc_id, {_terms_sql('text')} AS w FROM documents),
      places AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, lengths),
      grams AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM places),
      found AS (SELECT r, k, i, item_id FROM grams JOIN windows USING (k, g)),
      hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r),
      listed AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY encode(item_id)) AS items FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
      FROM docs LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)"""


def _op13_sql() -> str:
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms_sql('text')} AS t FROM documents),
      c AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS nd, CAST(sum(len(t)) AS BIGINT) AS l FROM d),
      p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
      f AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, nd),
      q AS (SELECT n, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS n, item_id, {_terms_sql('text')} AS t FROM benchmark)),
      m AS (SELECT r, doc_id, CAST(100 - 75 + (75 * len(t) * nd) // l AS BIGINT) AS m FROM d, c),
      s AS (SELECT n, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL),
      k AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
      SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10"""


def _op12_sql() -> str:
    """Levels by a recursion over the rows of all trees, folds by one over the depth; crc32 by its table."""
    field = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda n: f"sha256(concat({', '.join(map(field, ('doc_id', 'source', 'lang', n, 'text')))}))"
    up = "sha256(string_agg(h, '' ORDER BY i))"
    return f"""WITH RECURSIVE
      crc AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY n) AS t FROM range(256) r(n)),
      marks AS (SELECT doc_id, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, b: xor(t[xor(c & 255, b) + 1], c // 256))) % 7 = 0 AS marked FROM (SELECT DISTINCT doc_id FROM documents), crc),
      leaves AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, {leaf('n_chars')} AS h,
        CASE WHEN marked AND n_chars IS NOT NULL THEN {leaf('CAST(n_chars AS HUGEINT) + 1')} ELSE {leaf('n_chars')} END AS changed FROM documents LEFT JOIN marks USING (doc_id)),
      placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
      tree AS (SELECT g, 0 AS d, i, h, n FROM placed
        UNION ALL SELECT g, d + 1, i // 2, {up}, (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, d, i // 2, n),
      tops AS (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
      above AS (SELECT 0 AS d, i, h, n FROM tops
        UNION ALL SELECT d + 1, i // 2, {up}, (n + 1) // 2 FROM above WHERE n > 1 GROUP BY d, i // 2, n),
      steps AS (SELECT a.g, a.d, a.i, b.h AS sibling FROM tree a LEFT JOIN tree b ON a.g = b.g AND a.d = b.d AND b.i = xor(a.i, 1) WHERE a.n > 1),
      top_steps AS (SELECT a.d, a.i, b.h AS sibling FROM above a LEFT JOIN above b ON a.d = b.d AND b.i = xor(a.i, 1) WHERE a.n > 1),
      ways AS (SELECT p.g, p.i AS leaf_i, s.d, (p.i // CAST(pow(2, s.d) AS BIGINT)) % 2 AS side, s.sibling FROM placed p JOIN steps s ON s.g = p.g AND s.i = p.i // CAST(pow(2, s.d) AS BIGINT)
        UNION ALL SELECT p.g, p.i, 1000 + s.d, (t.i // CAST(pow(2, s.d) AS BIGINT)) % 2, s.sibling FROM placed p JOIN tops t USING (g) JOIN top_steps s ON s.i = t.i // CAST(pow(2, s.d) AS BIGINT)),
      numbered AS (SELECT *, row_number() OVER (PARTITION BY g, leaf_i ORDER BY d) AS k FROM ways),
      proofs AS (SELECT g, leaf_i, sha256(string_agg(coalesce(sibling, ''), '' ORDER BY k)) AS proof FROM numbered GROUP BY ALL),
      folds AS (SELECT g, i, 0 AS k, changed AS h FROM placed
        UNION ALL SELECT f.g, f.i, f.k + 1, sha256(CASE WHEN w.side = 1 THEN coalesce(w.sibling, '') || f.h ELSE f.h || coalesce(w.sibling, '') END)
        FROM folds f JOIN numbered w ON w.g = f.g AND w.leaf_i = f.i AND w.k = f.k + 1),
      ends AS (SELECT g, i, arg_max(h, k) AS folded FROM folds GROUP BY ALL),
      root AS (SELECT h FROM above WHERE n = 1)
      SELECT p.doc_id, p.h AS leaf, t.h AS subroot, (SELECT h FROM root) AS root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = (SELECT h FROM root) AS verified
      FROM placed p JOIN tops t USING (g) JOIN ends e ON e.g = p.g AND e.i = p.i LEFT JOIN proofs q ON q.g = p.g AND q.leaf_i = p.i"""


# The other methods hash, sketch, train or align, which SQL can't say; tests compare them with plain versions.
ORACLES: dict[str, str] = {"op1_url_filters": _op1_sql(), "op8_chat_format": _op8_sql(), "op11_benchmark_decontamination": _op11_sql(), "op12_merkle_manifest": _op12_sql(), "op13_ranked_search": _op13_sql()}
