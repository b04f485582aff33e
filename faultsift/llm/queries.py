"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.llm import align, bpe, conversation, html_text, langid, licenses, mixing, quality, rlz, simhash, suffix_tree, topk, warc
from faultsift.llm.common import new_dir, staged, tables

#: Target weights of the sources; all others share "*".
WEIGHTS = {"src0": 25, "src1": 10, "src2": 10, "src3": 5, "src4": 5, "*": 45}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary's file, by default the byte-level one; a parameter of the operators, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(tables(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, WEIGHTS, prefix="")
    return mixed.select("doc_id", "source", "stream", "block", "slot", "release", "deadline", F.col("at").alias("place"), F.col("units").alias("n_units"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "warc")
    warc.write(tables(spark, sf_dir, "pages"), path)
    found = warc.read(spark, path).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "body_digest": F.sha1("payload")})
    whole = warc.resolve(staged(found.drop("payload"), "warc-found"), ["payload_bytes", "body_digest"])
    return whole.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        F.col("body_digest").alias("payload_digest"),
        "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, path, keep=["doc_id"])
    back = bpe.decode(ids, path)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = langid.identify(tables(spark, sf_dir, "documents"), host=F.col("source"), keep=["doc_id", "lang"])
    return told.select("doc_id", F.col("lang").alias("declared"), "language", "text_language", "confidence", F.col("accepted").alias("kept"))


def pages_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on web pages, with their markup's language, address suffix and host."""
    visible = F.regexp_replace("html", r"(?is)<(script|style|head)\b.*?</\1>|<[^>]*>", " ")
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    pages = tables(spark, sf_dir, "pages").select(
        "page_id", host.alias("host"), visible.alias("text"), F.lower(F.regexp_extract("html", r'(?i)<html[^>]*\blang="?([a-z]+)', 1)).alias("markup")
    )
    pages = pages.withColumn("markup", F.nullif("markup", F.lit("")))
    told = langid.identify(pages, declared="markup", host=F.col("host"), suffix=F.regexp_extract("host", r"\.([a-z]+)$", 1), keep=["page_id", "host", "markup"])
    return told.withColumnRenamed("accepted", "kept")


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = suffix_tree.score(tables(spark, sf_dir, "documents"), held_out())
    return scored.withColumnRenamed("id", "doc_id")


def op7_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(tables(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages, keep=["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(tables(spark, sf_dir, "embeddings"))
    found = topk.top_k(vectors, vectors.where("id % 50 = 0"), 5)
    return found.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op10_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = rlz.remove(tables(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text")
    made = align.align(docs, a, b, keep=["doc_id"])
    sha = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = staged(made.withColumn("groups_sha256", sha).drop("groups"), "aligned")
    return align.score(aligned, align.pieces(b)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(tables(spark, sf_dir, "documents"), keep=["doc_id"]).drop("spans")


def op13_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair(conversation.damaged(tables(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_mix": op2_mix,
    "op3_warc": op3_warc,
    "op4_bpe": op4_bpe,
    "op5_langid": op5_langid,
    "op6_suffix_tree": op6_suffix_tree,
    "op7_divergence": op7_divergence,
    "op8_html": op8_html,
    "op9_topk": op9_topk,
    "op10_rlz": op10_rlz,
    "op11_align": op11_align,
    "op12_licenses": op12_licenses,
    "op13_conversation": op13_conversation,
    "pages_langid": pages_langid,
}

_PERIOD = sum(WEIGHTS.values())
_LANGS = ", ".join(f"'{x}'" for x in quality.COMMON)
_COMMON = " ".join(
    f"WHEN '{lang}' THEN [" + ", ".join("len(list_filter(w, lambda x: x IN ('{}', '{}', '{}')))".format(c, c.capitalize(), c.upper()) for c in words) + "]"
    for lang, words in quality.COMMON.items()
)


def _js(name: str, of: str, all_: str) -> str:
    """SQL of the Jensen-Shannon distance of each document's list of counts from the sums of its language."""
    term = lambda p: f"CASE WHEN {p} > 0 THEN {p} * log2({p} / ((p + q) / 2)) ELSE 0 END"
    return f"""{name} AS (SELECT doc_id, sqrt(greatest(0, sum(({term('p')} + {term('q')}) / 2))) AS d FROM (
  SELECT doc_id, v / sum(v) OVER (PARTITION BY doc_id) AS p, u / sum(u) OVER (PARTITION BY doc_id) AS q
  FROM (SELECT doc_id, unnest({of})::DOUBLE AS v, unnest({all_})::DOUBLE AS u FROM f JOIN ref ON f.l = ref.l) AS x) AS y GROUP BY doc_id)"""

def _edit(state: str, cost: str, letter: str, line: str = "") -> str:
    """SQL of a state's path (cost, audit, lines) with one edit more; null if the state was not reached."""
    lines = f"list_append({state}.l, {line})" if line else f"{state}.l"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'l': {lines}}} END"


def _row_of(to: str, befores: str, made: bool = True) -> str:
    """SQL of the best path to state u or a (or s) by deleting, keeping or re-roling the row r."""
    role = {"u": "user", "a": "assistant"}.get(to)
    ways = [_edit(f"p.{to}", "2", "D")]
    for b in befores:
        ways.append(f"CASE WHEN NOT r.must AND left(r.role, 1) = '{to}' THEN {_edit(f'p.{b}', 'r.extra', 'K', 'r.role || chr(58) || r.text')} END")
        if made:
            ways.append(f"CASE WHEN NOT r.must THEN {_edit(f'p.{b}', '1 + r.extra', 'R', f'{chr(39)}{role}:{chr(39)} || r.text')} END")
    return f"least({', '.join(ways)})"


#: Empty rows inserted after a row (or before the first): at most one of each role is worth its cost.
_U1 = f"least(u, {_edit('z', '5', 'I', chr(39) + 'user:' + chr(39))}, {_edit('s', '5', 'I', chr(39) + 'user:' + chr(39))}, {_edit('a', '5', 'I', chr(39) + 'user:' + chr(39))})"
_A1 = f"least(a, {_edit('u', '5', 'I', chr(39) + 'assistant:' + chr(39))})"

ORACLE: dict[str, str] = {
    # earliest deadline first, slot by slot; then the rows of each stream in the order of their keys
    "op2_mix": f"""
WITH RECURSIVE streams AS (
  SELECT * FROM (VALUES {", ".join(f"({i}, '{s}', {w})" for i, (s, w) in enumerate(WEIGHTS.items()))}) AS v(i, stream, w)
), sim AS (
  SELECT -1 AS t, list_transform(range({len(WEIGHTS)}), lambda x: 0) AS nxt, -1 AS pick
  UNION ALL
  SELECT t + 1, list_transform(nxt, lambda x, j: CASE WHEN j = p + 1 THEN x + 1 ELSE x END), p
  FROM (SELECT t, nxt, (SELECT i FROM streams WHERE nxt[i + 1] < w AND (nxt[i + 1] * {_PERIOD}) // w <= t + 1
        ORDER BY ((nxt[i + 1] + 1) * {_PERIOD} + w - 1) // w, i LIMIT 1) AS p FROM sim WHERE t + 1 < {_PERIOD}) AS s
), plan AS (
  SELECT t AS s, i, stream, w, nxt[pick + 1] - 1 AS k FROM sim JOIN streams ON pick = i
), keyed AS (
  SELECT doc_id, source, CASE WHEN source IN ({", ".join(f"'{s}'" for s in WEIGHTS if s != "*")}) THEN source ELSE '*' END AS stream,
    greatest(length(coalesce(text, '')), 1) AS n_units, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), placed AS (
  SELECT *, CAST(sum(n_units) OVER (PARTITION BY stream ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - n_units AS start FROM keyed
), blocks AS (
  SELECT *, start // {mixing.BLOCK_UNITS} AS block, start % {mixing.BLOCK_UNITS} AS place FROM placed
)
SELECT doc_id, source, b.stream AS stream, block, s + (block // w) * {_PERIOD} AS slot,
  (k * {_PERIOD}) // w + (block // w) * {_PERIOD} AS "release",
  ((k + 1) * {_PERIOD} + w - 1) // w + (block // w) * {_PERIOD} AS deadline, place, n_units
FROM blocks b JOIN plan p ON b.stream = p.stream AND b.block % p.w = p.k""",
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(strlen(html), 0) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < kept THEN kept END AS refers_to FROM k""",
    "op7_divergence": rf"""
WITH d AS (SELECT doc_id, CASE WHEN lang IN ({_LANGS}) THEN lang ELSE '*' END AS l, coalesce(text, '') AS t,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT *, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) AS BIGINT) AS chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS upper,
  length(regexp_replace(t, '[^\p{{Nd}}]', '', 'g')) AS digits, length(regexp_replace(t, '[^.,;:!?''"()\-]', '', 'g')) AS points,
  CASE l {_COMMON} ELSE [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0] END AS found FROM d),
f AS (SELECT doc_id, l, n_words, word_chars, chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  [greatest(0, word_chars - upper - digits - points - n_symbols), upper, digits, points, n_symbols, chars - word_chars] AS classes,
  list_append(found, greatest(0, n_words - list_sum(found))) AS hist FROM c),
g AS (SELECT doc_id, unnest(range(len(w) - 2)) AS i, w FROM d WHERE len(w) >= 3),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i + 1], w[i + 2], w[i + 3]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM k WHERE n > 1) AS u GROUP BY 1),
ref AS (SELECT l, [{", ".join(f"sum(classes[{i}])" for i in range(1, 7))}] AS rc, [{", ".join(f"sum(hist[{i}])" for i in range(1, 14))}] AS rh FROM f LEFT JOIN r ON f.doc_id = r.doc_id
  WHERE n_words >= {quality.LEAST_WORDS} AND 100 * coalesce(r.n, 0) <= {quality.MOST_REPEATED} * n_words GROUP BY 1),
{_js("cd", "classes", "rc")}, {_js("wd", "hist", "rh")},
o AS (SELECT f.*, coalesce(r.n, 0) AS n_repeat_words, CASE WHEN chars >= {quality.LEAST_CHARS} THEN cd.d END AS cdist,
  CASE WHEN l <> '*' AND n_words >= {quality.LEAST_COMPARED_WORDS} THEN wd.d END AS wdist
  FROM f LEFT JOIN r ON f.doc_id = r.doc_id LEFT JOIN cd ON f.doc_id = cd.doc_id LEFT JOIN wd ON f.doc_id = wd.doc_id),
b AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cdist, 6) AS char_distance, round(wdist, 6) AS word_distance,
  NOT base_failed AND coalesce(cdist, 0) <= {quality.MOST_CHAR_DISTANCE} AND coalesce(wdist, 0) <= {quality.MOST_WORD_DISTANCE} AS kept FROM b""",
    "op9_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    # the best path to each state, row by row
    "op13_conversation": rf"""
WITH RECURSIVE f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
b AS (SELECT key, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(octet_length(encode(key))), lambda i: ascii(key[i + 1])::UBIGINT)), lambda c, x:
  list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda v, y: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)) AS crc FROM (SELECT DISTINCT key FROM f)),
g AS (SELECT f.*, xor(crc, 4294967295::UBIGINT) % 20 AS fault FROM f JOIN b ON f.key = b.key),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
  CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS found FROM d),
k AS (SELECT *, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
r AS (SELECT *, found IN ('blank', 'duplicate') AS must, CASE WHEN found = 'truncated' THEN 5 ELSE 0 END AS extra FROM o),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (found = 'blank') AS blank, count(*) FILTER (found = 'duplicate') AS duplicate,
  count(*) FILTER (found = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n_rows FROM k GROUP BY conv_id),
p AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'l': []::VARCHAR[]}} AS z, NULL::STRUCT(c BIGINT, a VARCHAR, l VARCHAR[]) AS s, {{'c': 5::BIGINT, 'a': 'I', 'l': ['user:']}} AS u,
    {{'c': 10::BIGINT, 'a': 'II', 'l': ['user:', 'assistant:']}} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, z, s, {_U1} AS u, {_A1} AS a FROM (SELECT conv_id, i, z, s, {_U1} AS u, {_A1} AS a FROM (
    SELECT p.conv_id AS conv_id, p.i + 1 AS i, {_edit("p.z", "2", "D")} AS z, {_row_of("s", "z", False)} AS s, {_row_of("u", "zsa")} AS u, {_row_of("a", "u")} AS a
    FROM p JOIN r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = p.i + 1))
), e AS (SELECT conv_id, i, least(z, a) AS best FROM p)
SELECT e.conv_id AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(array_to_string(best.l, chr(10))) AS repaired_sha256
FROM e LEFT JOIN n ON e.conv_id IS NOT DISTINCT FROM n.conv_id WHERE e.i = coalesce(n_rows, 0)""",
    "op10_rlz": """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(len(ws) - 12)) AS i, ws FROM w WHERE len(ws) >= 13),
h AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 13], ' ') AS win FROM g),
d AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) < doc_id AS dup FROM h),
c AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM d WHERE dup) AS u GROUP BY doc_id),
k AS (SELECT w.doc_id AS doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN c ON w.doc_id = c.doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(ws, lambda x, j: NOT list_contains(gone, j - 1)), ' ')) AS kept_sha256 FROM k""",
}
