"""Queries over documents, chunks and single texts: segmentation, cleaning, parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as T
from ..operators import matching, resolve, segment
from ..operators.components import keep_first
from ..sources.tables import table
from .base import SQL_CANDIDATES, SQL_CHUNKS, SQL_ENTITIES, SQL_OUTCOMES, SQL_EVERY_TRIPLE, SQL_RESULTS, SQL_TRIPLES, UWS, candidates, chunks, entities, every_triple, outcomes, results, rnd, sq, sql_part, triples, words

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


#: Sentence split in SQL: initials are protected by one mark, sentence gaps become another.
_INITIALS = "regexp_replace({}, '((?:^|[^\\p{{L}}\\p{{N}}_])[A-Za-z]\\.)(\\s+)', '\\1' || chr(2) || '\\2', 'g')"
_SENTS = (
    "list_filter(list_transform(string_split(regexp_replace(" + _INITIALS.format(_INITIALS.format("text")) + ", '([.!?])\\s+', '\\1' || chr(3), 'g'), chr(3)), "
    "lambda x: replace(x, chr(2), '')), lambda x: regexp_replace(x, '\\s+', '', 'g') <> '')"
)


@query("scan_documents", f"SELECT 'doc_' || doc_id AS doc_key, length(text)::INT AS n_code_points, {words('text')}::INT AS n_words FROM documents")
def scan_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("doc_key"), F.length("text").alias("n_code_points"), T.word_count(F.col("text")).alias("n_words"))


@query(
    "filter_docs",
    "SELECT doc_id, source FROM documents WHERE source IN ('glossary', 'news_drop', 'crawl_alpha') AND doc_id BETWEEN 1 AND 5000 AND ('doc_' || doc_id) NOT IN (SELECT doc_id FROM chunks WHERE doc_id IS NOT NULL) ORDER BY doc_id LIMIT 40",
)
def filter_docs(spark: SparkSession, d: str) -> DataFrame:
    """Named sources, an inclusive range, not done yet, then a limit, in this order; the limit is the feature."""
    docs = table(spark, d, "documents").where(F.col("source").isin("glossary", "news_drop", "crawl_alpha")).where("doc_id between 1 and 5000").select("doc_id", "source")
    done = table(spark, d, "chunks").select("doc_id").where("doc_id is not null").distinct()
    todo = docs.withColumn("key", F.concat(F.lit("doc_"), "doc_id")).join(done.withColumnRenamed("doc_id", "key"), "key", "left_anti")
    return todo.select("doc_id", "source").orderBy("doc_id").limit(40)


@query("sample_docs", "SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 25")
def sample_docs(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample: the first of the documents by hash. The limit is the feature."""
    return table(spark, d, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id")).cast("binary")), "doc_id").limit(25)


@query(
    "chunk_documents",
    f"""WITH s AS (SELECT doc_id, text, {_SENTS} AS s FROM documents), t AS (SELECT doc_id, CASE WHEN len(s) > 0 THEN s ELSE [text] END AS s FROM s),
c AS (SELECT doc_id, k + 1 AS chunk_id, {sq("array_to_string(s[k * 4 + 1 : k * 4 + 4], ' ')")} AS text FROM (SELECT doc_id, s, unnest(range((len(s) + 3) // 4)) AS k FROM t))
SELECT doc_id, chunk_id::INT AS chunk_id, text, {words('text')}::INT AS word_count FROM c""",
)
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return segment.sentence_chunks(table(spark, d, "documents"), ["doc_id"])


@query("word_stats", f"SELECT lang, count(*) AS n_docs, sum({words('text')})::BIGINT AS n_words, max({words('text')})::INT AS longest FROM documents GROUP BY lang")
def word_stats(spark: SparkSession, d: str) -> DataFrame:
    n = T.word_count(F.col("text"))
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_words"), F.max(n).alias("longest"))


@query("rule_sentences", f"SELECT doc_id, len({_SENTS})::INT AS n_sentences FROM documents")
def rule_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(segment.rule_sentences(F.col("text"))).alias("n_sentences"))


@query("sentence_numbers", f"WITH s AS (SELECT doc_id, {_SENTS} AS s FROM documents), p AS (SELECT doc_id, unnest(s) AS sentence, unnest(range(1, len(s) + 1)) AS n FROM s) SELECT doc_id, sentence, max(n)::INT AS sentence_no FROM p GROUP BY 1, 2")
def sentence_numbers(spark: SparkSession, d: str) -> DataFrame:
    return segment.sentence_numbers(table(spark, d, "documents"), ["doc_id"])


@query("char_chunks")
def char_chunks(spark: SparkSession, d: str) -> DataFrame:
    return segment.char_chunks(table(spark, d, "documents"), most=3000)


@query("paragraph_chunks")
def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    return segment.paragraph_chunks(table(spark, d, "documents"))


@query("chunk_sizes", f"SELECT pipeline, count(*) AS n_chunks, sum({words('text')})::BIGINT AS n_words, max(length(text))::INT AS longest FROM {SQL_CHUNKS} GROUP BY 1")
def chunk_sizes(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).groupBy("pipeline").agg(F.count("*").alias("n_chunks"), F.sum(T.word_count(F.col("text"))).alias("n_words"), F.max(F.length("text")).alias("longest"))


@query("clean_entities", f"SELECT ent_id, nullif(lower(array_to_string(string_split({sq('name')}, ' ')[1:3], ' ')), '') AS entity FROM {SQL_ENTITIES}")
def clean_entities(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).select("ent_id", T.clean_entity(F.col("name")).alias("entity"))


@query("clean_relations", f"SELECT triple_id, lower({sq('relation')}) AS relation FROM {SQL_TRIPLES}")
def clean_relations(spark: SparkSession, d: str) -> DataFrame:
    return triples(spark, d).select("triple_id", T.clean_relation(F.col("relation")).alias("relation"))


_NORM = "regexp_replace(regexp_replace(lower({}), '^[!-/:-@\\[-`{{-~\\s]+|[!-/:-@\\[-`{{-~\\s]+$', '', 'g'), '^(a|an|the)\\s+', '')"


@query("normalize_entities", f"SELECT ent_id, norm FROM (SELECT ent_id, {_NORM.format(sq('name'))} AS norm FROM {SQL_ENTITIES}) WHERE norm <> ''")
def normalize_entities(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).select("ent_id", resolve.normalized(F.col("name")).alias("norm")).where("norm <> ''")


@query(
    "match_form",
    "SELECT triple_id, regexp_replace(regexp_replace(lower(" + sq("object") + "), '\\s+([^\\w\\s])', '\\1', 'g'), '([^\\w\\s])\\s+', '\\1', 'g') AS form FROM " + SQL_TRIPLES,
)
def match_form(spark: SparkSession, d: str) -> DataFrame:
    return triples(spark, d).select("triple_id", T.for_match(F.col("object")).alias("form"))


@query("squashed_names", f"SELECT doc_id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS squashed, count(*) AS n FROM {SQL_ENTITIES} GROUP BY 1, 2")
def squashed_names(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).groupBy("doc_id", T.letters_and_digits(F.col("name")).alias("squashed")).agg(F.count("*").alias("n"))


@query("edge_strings", f"SELECT triple_id, lower(trim(subject || ';' || relation || ';' || object)) AS edge FROM {SQL_TRIPLES}")
def edge_strings(spark: SparkSession, d: str) -> DataFrame:
    return triples(spark, d).select("triple_id", T.edge_string(F.col("subject"), F.col("relation"), F.col("object")).alias("edge"))


_SRO = [sq(x) for x in ("subject", "relation", "object")]


@query("verbalized", f"SELECT triple_id, concat_ws(' ', nullif({_SRO[0]}, ''), nullif({_SRO[1]}, ''), nullif({_SRO[2]}, '')) AS statement, {_SRO[0]} || ' ' || {_SRO[1]} || ' ' || {_SRO[2]} || '.' AS templated FROM {SQL_TRIPLES}")
def verbalized(spark: SparkSession, d: str) -> DataFrame:
    s, r, o = (F.col(c) for c in ("subject", "relation", "object"))
    return triples(spark, d).select("triple_id", T.verbalized(s, r, o).alias("statement"), T.templated(s, r, o).alias("templated"))


@query(
    "malformed_triples",
    f"SELECT pipeline, count(*) AS n, count(*) FILTER (WHERE subject IS NULL OR relation IS NULL OR object IS NULL) AS n_missing, count(*) FILTER (WHERE coalesce({_SRO[0]}, '') = '' OR coalesce({_SRO[1]}, '') = '' OR coalesce({_SRO[2]}, '') = '') AS n_malformed FROM {SQL_EVERY_TRIPLE} GROUP BY 1",
)
def malformed_triples(spark: SparkSession, d: str) -> DataFrame:
    """Triples with a missing or blank part, payloads that do not parse among them."""
    missing = F.col("subject").isNull() | F.col("relation").isNull() | F.col("object").isNull()
    bad = T.malformed(F.col("subject"), F.col("relation"), F.col("object"))
    return every_triple(spark, d).groupBy("pipeline").agg(F.count("*").alias("n"), F.count_if(missing).alias("n_missing"), F.count_if(bad).alias("n_malformed"))


_ENDS = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_FENCE = _ENDS.format("regexp_replace(regexp_replace(" + _ENDS.format("{0}") + ", '^```(json)?\\s*', ''), '\\s*```$', '')")


@query("unfenced_answers", f"SELECT result_id, {_FENCE.format('content')} AS body FROM {SQL_RESULTS} WHERE content IS NOT NULL")
def unfenced_answers(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).where("content is not null").select("result_id", T.without_fence(F.col("content")).alias("body"))


@query("without_thinking", f"SELECT result_id, CASE WHEN instr(content, '</think>') > 0 THEN trim(substr(content, instr(content, '</think>') + 8)) ELSE content END AS body FROM {SQL_RESULTS} WHERE content IS NOT NULL")
def without_thinking(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).where("content is not null").select("result_id", T.without_thinking(F.col("content")).alias("body"))


#: SQL for the first line of an answer without fence, label and outer quotes; {} stands for the answer.
STATEMENT = f"""nullif({_ENDS.format("regexp_replace(" + _ENDS.format("string_split(regexp_replace(" + _FENCE.format("{0}") + ", '(?i)^statement:\\s*', ''), chr(10))[1]") + ", '^" + '"|"' + "$', '', 'g')")}, '')"""


@query("parsed_statements", f"SELECT result_id, {STATEMENT.format('content')} AS statement FROM {SQL_RESULTS} WHERE custom_id LIKE 'statement|%' AND content IS NOT NULL")
def parsed_statements(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).where("custom_id like 'statement|%' and content is not null").select("result_id", T.parsed_statement(F.col("content")).alias("statement"))


@query("json_prompts", "SELECT doc_id, CASE WHEN contains(lower(title), 'json') THEN title ELSE title || chr(10) || chr(10) || 'Answer in JSON.' END AS prompt FROM documents WHERE title IS NOT NULL")
def json_prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("title is not null").select("doc_id", T.with_json_word(F.col("title")).alias("prompt"))


@query(
    "triple_prompts",
    f"SELECT doc_id, 'Entities: ' || array_to_string(list_sort(list(DISTINCT name)), ', ') AS prompt FROM {SQL_ENTITIES} WHERE name IS NOT NULL AND doc_id <> 'doc_1' GROUP BY doc_id"
    f" UNION ALL SELECT doc_id, 'Entities: ' || array_to_string(list_sort(list(DISTINCT name)), ', ') FROM {SQL_ENTITIES} WHERE name IS NOT NULL AND doc_id = 'doc_1' GROUP BY doc_id",
)
def triple_prompts(spark: SparkSession, d: str) -> DataFrame:
    """A prompt lists all distinct entities of its document, sorted: the list is the product here."""
    names = entities(spark, d).where("name is not null").select("doc_id", "name").distinct()
    return names.groupBy("doc_id").agg(F.concat(F.lit("Entities: "), F.array_join(F.array_sort(F.collect_list("name")), ", ")).alias("prompt"))


@query(
    "char_jaccard",
    f"""SELECT c.doc_id, ent_a, ent_b, round(len(list_intersect(list_distinct(string_split(lower(x.name), '')), list_distinct(string_split(lower(y.name), ''))))::DOUBLE
 / len(list_distinct(list_concat(string_split(lower(x.name), ''), string_split(lower(y.name), '')))), 6) AS jaccard
FROM (SELECT DISTINCT doc_id, ent_a, ent_b FROM candidate_pairs) c JOIN {SQL_ENTITIES} x ON x.doc_id = c.doc_id AND x.ent_key = ent_a JOIN {SQL_ENTITIES} y ON y.doc_id = c.doc_id AND y.ent_key = ent_b""",
)
def char_jaccard(spark: SparkSession, d: str) -> DataFrame:
    names = entities(spark, d).select("doc_id", "ent_key", F.lower("name").alias("name"))
    pairs = table(spark, d, "candidate_pairs").select("doc_id", "ent_a", "ent_b").distinct()
    both = pairs.join(names.toDF("doc_id", "ent_a", "x"), ["doc_id", "ent_a"]).join(names.toDF("doc_id", "ent_b", "y"), ["doc_id", "ent_b"])
    return both.select("doc_id", "ent_a", "ent_b", rnd(T.char_jaccard(F.col("x"), F.col("y"))).alias("jaccard"))


@query("percents", "SELECT p_partkey, try_cast(regexp_replace(trim(t), '\\s*%$', '') AS DOUBLE) AS value FROM (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'n/a' ELSE p_size || '.5 %' END AS t FROM part)")
def percents(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("p_size") % 7 == 0, "n/a").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5 %")))
    return table(spark, d, "part").select("p_partkey", T.percent(t).alias("value"))


@query("config_hashes", "SELECT pipeline, substr(sha256(pipeline || ':' || unit || ':' || max_size), 1, 12) AS hash FROM size_limits")
def config_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "size_limits").select("pipeline", T.config_hash(F.concat_ws(":", "pipeline", "unit", F.col("max_size").cast("string"))).alias("hash"))


@query("name_classes", "SELECT class, count(*) AS n FROM (SELECT CASE WHEN contains(lower(source), 'crawl') THEN 'web' WHEN contains(lower(source), 'news') THEN 'press' WHEN contains(lower(source), 'wiki') THEN 'reference' ELSE 'other' END AS class FROM documents) GROUP BY 1")
def name_classes(spark: SparkSession, d: str) -> DataFrame:
    rules = [("crawl", "web"), ("news", "press"), ("wiki", "reference")]
    return table(spark, d, "documents").select(T.name_class(F.col("source"), rules, "other").alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("normalized_triples", f"SELECT DISTINCT triple_id, {', '.join(f'{sql_part(n)} AS {n}' for n in A.ALIASES)} FROM triples")
def normalized_triples(spark: SparkSession, d: str) -> DataFrame:
    return A.triple_columns(table(spark, d, "triples").select("triple_id", "subject", "relation", "object", "payload")).select("triple_id", *A.ALIASES).distinct()


@query("answer_triples")
def answer_triples(spark: SparkSession, d: str) -> DataFrame:
    return A.answer_triples(results(spark, d).where("custom_id like 'triples|%' and content is not null"), "content", ["result_id"])


@query(
    "binary_verdicts",
    f"SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN t IN ('1', 'true', 'yes') THEN 1 WHEN t IN ('0', 'false', 'no') THEN 0 END AS verdict FROM (SELECT lower(regexp_replace({_ENDS.format('content')}, '^" + '"|"' + f"$|\\.$', '', 'g')) AS t FROM {SQL_RESULTS} WHERE custom_id LIKE 'pair|%' AND content IS NOT NULL)) GROUP BY 1",
)
def binary_verdicts(spark: SparkSession, d: str) -> DataFrame:
    pairs = results(spark, d).where("custom_id like 'pair|%' and content is not null")
    return pairs.select(A.binary_verdict(F.col("content")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


_VERDICT = "CASE WHEN v IN ('SUPPORTED', 'NOT_SUPPORTED') THEN v WHEN v IN ('CONTRADICTED', 'NOT_STATED') THEN 'NOT_SUPPORTED' ELSE 'JUDGE_ERROR' END"


@query("verdict_parse", f"SELECT outcome_id, {_VERDICT} AS verdict FROM (SELECT outcome_id, translate(upper({_ENDS.format('verdict')}), '- ', '__') AS v FROM {SQL_OUTCOMES})")
def verdict_parse(spark: SparkSession, d: str) -> DataFrame:
    return outcomes(spark, d).select("outcome_id", A.verdict(F.col("verdict")).alias("verdict"))


@query("categories", "SELECT doc_id, CASE WHEN c IN ('MINE', 'SCIERC') THEN c END AS category FROM (SELECT doc_id, translate(upper(collection), '- ', '__') AS c FROM documents)")
def categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", A.category(F.col("collection"), ("MINE", "SCIERC")).alias("category"))


@query(
    "response_status",
    f"SELECT provider, status, count(*) AS n FROM (SELECT provider, CASE WHEN NOT coalesce(success, false) THEN 'error' WHEN content IS NULL THEN 'missing' WHEN status_code >= 400 THEN 'status' ELSE 'ok' END AS status FROM {SQL_RESULTS}) GROUP BY 1, 2",
)
def response_status(spark: SparkSession, d: str) -> DataFrame:
    s = A.response_status(F.col("success"), F.col("status_code"), F.col("content"))
    return results(spark, d).select("provider", s.alias("status")).groupBy("provider", "status").agg(F.count("*").alias("n"))


@query(
    "response_text",
    "SELECT event_id, event_type || '|' || (json_extract(props, '$.k')::INT) AS text FROM events",
)
def response_text(spark: SparkSession, d: str) -> DataFrame:
    """Nested answer bodies built from the events, then taken apart again."""
    part = lambda c: F.struct(F.array(F.struct(c.alias("text"))).alias("content"))
    body = F.to_json(F.struct(F.array(part(F.col("event_type")), part(F.lit("|")), part(F.get_json_object("props", "$.k"))).alias("output")))
    return table(spark, d, "events").select("event_id", A.response_text(body).alias("text"))


@query("triple_validity", f"SELECT pipeline, count(*) AS n, count(*) FILTER (WHERE NOT (contains(lower(relation), lower(subject)) OR contains(lower(relation), lower(object)))) AS n_valid FROM {SQL_TRIPLES} GROUP BY 1")
def triple_validity(spark: SparkSession, d: str) -> DataFrame:
    ok = resolve.valid_relation(F.col("subject"), F.col("relation"), F.col("object"))
    return triples(spark, d).groupBy("pipeline").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_valid"))


@query("quoted_entities", f"SELECT ent_id, name FROM {SQL_ENTITIES} WHERE NOT contains(name, '" + '"' + "')")
def quoted_entities(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).where(~F.contains("name", F.lit('"'))).select("ent_id", "name")


@query("span_containment", f"SELECT cand_id, CASE WHEN trim(coalesce({sq('supporting_span')}, '')) = '' THEN false ELSE contains(lower({sq('c.text')}), lower({sq('supporting_span')})) END AS contained FROM {SQL_CANDIDATES} s JOIN {SQL_CHUNKS} c USING (chunk_uid)")
def span_containment(spark: SparkSession, d: str) -> DataFrame:
    span = F.lower(T.squeeze(F.col("supporting_span")))
    both = candidates(spark, d).join(chunks(spark, d).select("chunk_uid", "text"), "chunk_uid")
    return both.select("cand_id", F.when(F.coalesce(span, F.lit("")) == "", False).otherwise(F.contains(F.lower(T.squeeze(F.col("text"))), span)).alias("contained"))


_SAID_VERDICT = f"SELECT custom_id, nullif(translate(upper({_ENDS.format('last(verdict ORDER BY judged_at, outcome_id)')}), '- ', '__'), '') AS v FROM judge_outcomes GROUP BY 1"


@query(
    "fact_filter_reasons",
    f"""SELECT cand_id, CASE WHEN error IS NOT NULL OR v IS NULL THEN 'parse_error' WHEN coalesce(span_mismatch, false) THEN 'span_not_in_text' WHEN v = 'CONTRADICTED' THEN 'contradicted' WHEN v = 'NOT_STATED' THEN 'not_stated'
WHEN v <> 'SUPPORTED' THEN 'unknown_verdict' END AS drop_reason FROM {SQL_CANDIDATES} LEFT JOIN ({_SAID_VERDICT}) j ON j.custom_id = 'judge|' || doc_id || '|' || fact_ord""",
)
def fact_filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Facts with the last verdict on their place, and the first reason to drop them."""
    from .asking import drop_reason

    said = table(spark, d, "judge_outcomes").groupBy("custom_id").agg(F.max(F.struct("judged_at", "outcome_id", "verdict"))["verdict"].alias("v"))
    v = T.blank_to_null(F.translate(F.upper(T.squeeze_ends(F.col("v"))), "- ", "__"))
    rows = candidates(spark, d).withColumn("custom_id", F.concat_ws("|", F.lit("judge"), "doc_id", F.col("fact_ord").cast("string"))).join(said, "custom_id", "left")
    return rows.select("cand_id", drop_reason(v, F.col("span_mismatch"), F.col("error")).alias("drop_reason"))


@query("candidate_cap", f"SELECT cand_id, doc_id FROM {SQL_CANDIDATES} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY fact_ord, cand_id) <= 3")
def candidate_cap(spark: SparkSession, d: str) -> DataFrame:
    """The first facts of each document; the cap is the feature."""
    w = Window.partitionBy("doc_id").orderBy("fact_ord", "cand_id")
    return candidates(spark, d).select("cand_id", "doc_id", F.row_number().over(w).alias("k")).where("k <= 3").drop("k")


@query("generic_relations", f"SELECT triple_id FROM {SQL_TRIPLES} WHERE lower({sq('relation')}) NOT IN ('related to', 'relates_to')")
def generic_relations(spark: SparkSession, d: str) -> DataFrame:
    return triples(spark, d).where(~T.clean_relation(F.col("relation")).isin("related to", "relates_to")).select("triple_id")


@query("last_row_wins", "SELECT custom_id, result_id, provider FROM batch_results QUALIFY row_number() OVER (PARTITION BY custom_id ORDER BY finished_at DESC, result_id DESC) = 1")
def last_row_wins(spark: SparkSession, d: str) -> DataFrame:
    """The last answer of each request, by a grouped maximum instead of a sort."""
    last = table(spark, d, "batch_results").groupBy("custom_id").agg(F.max(F.struct("finished_at", "result_id", "provider")).alias("m"))
    return last.select("custom_id", "m.result_id", "m.provider")


@query(
    "error_overrides",
    f"SELECT custom_id, arg_max(result_id, (CASE WHEN success THEN 0 ELSE 1 END) * 1000000000 + result_id) AS result_id, bool_or(NOT success) AS failed FROM {SQL_RESULTS} GROUP BY 1",
)
def error_overrides(spark: SparkSession, d: str) -> DataFrame:
    """A failed answer overrides the successful ones of its request."""
    rows = results(spark, d).withColumn("bad", F.when(F.col("success"), 0).otherwise(1))
    return rows.groupBy("custom_id").agg(F.max(F.struct("bad", "result_id")).alias("m")).select("custom_id", "m.result_id", (F.col("m.bad") == 1).alias("failed"))


@query("todo_anti", f"SELECT DISTINCT custom_id FROM {SQL_RESULTS} r WHERE NOT EXISTS (SELECT 1 FROM batch_results b WHERE b.custom_id = r.custom_id AND b.success AND b.content IS NOT NULL)")
def todo_anti(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d)
    return rows.select("custom_id").distinct().join(rows.where("success and content is not null").select("custom_id"), "custom_id", "left_anti")


@query("ordered_distinct_names", f"SELECT doc_id, lower(name) AS name, min(ent_id) AS ent_id FROM {SQL_ENTITIES} GROUP BY 1, 2")
def ordered_distinct_names(spark: SparkSession, d: str) -> DataFrame:
    rows = entities(spark, d).withColumn("low", F.lower("name"))
    return keep_first(rows, [F.col("doc_id"), F.col("low")], [F.col("ent_id")]).select("doc_id", F.col("low").alias("name"), "ent_id")


def known_names(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, name): entities of each document, from the entity table and from the subjects of its triples."""
    return entities(spark, d).select("doc_id", "name").unionByName(triples(spark, d).select("doc_id", F.col("subject").alias("name"))).where("name is not null").distinct()


@query("entity_matches")
def entity_matches(spark: SparkSession, d: str) -> DataFrame:
    """Entities of the document inside each object, longest first where they overlap, and the text around them."""
    names = known_names(spark, d).select("doc_id", resolve.normalized(F.col("name")).alias("name")).where("length(name) > 1")
    objects = triples(spark, d).select("triple_id", "doc_id", resolve.normalized(F.col("object")).alias("obj"))
    found = matching.matches(objects, names, ["triple_id", "obj"], "doc_id", "obj", "name")
    return found.select("triple_id", F.size("found").alias("n"), matching.segments(F.col("obj"), F.col("found")).alias("parts"))


@query("fact_entity_labels")
def fact_entity_labels(spark: SparkSession, d: str) -> DataFrame:
    """Facts by the number of entities of their document that they name."""
    facts = candidates(spark, d).where("fact is not null").select("cand_id", "doc_id", T.for_match(F.col("fact")).alias("fact"))
    names = known_names(spark, d).select("doc_id", T.for_match(F.col("name")).alias("name")).where("length(name) > 1")
    found = matching.matches(facts, names, ["cand_id"], "doc_id", "fact", "name")
    rows = facts.select("cand_id").join(found, "cand_id", "left")
    n = F.size(F.array_distinct(F.transform("found", lambda s: s["term"])))
    return rows.select("cand_id", T.entity_label(F.when(F.col("found").isNull(), 0).otherwise(n)).alias("label"))


@query("object_resolution")
def object_resolution(spark: SparkSession, d: str) -> DataFrame:
    from .pipeline import repaired

    return repaired(triples(spark, d), known_names(spark, d))


_W = "[\\p{L}\\p{N}_]"
_BEFORE = f"(CASE WHEN regexp_matches(t, '^{_W}') THEN '(?:^|[^\\p{{L}}\\p{{N}}_])' ELSE '{_W}' END)"
_AFTER = f"(CASE WHEN regexp_matches(t, '{_W}$') THEN '(?:$|[^\\p{{L}}\\p{{N}}_])' ELSE '{_W}' END)"


@query(
    "first_places",
    f"""WITH s AS (SELECT triple_id, lower(evidence) AS e, lower(subject) AS t FROM {SQL_TRIPLES} WHERE evidence IS NOT NULL AND subject <> '')
SELECT triple_id, length(regexp_extract(e, '(?s)^(.*?' || {_BEFORE} || ')' || regexp_escape(t) || {_AFTER}, 1))::INT AS place FROM s WHERE regexp_matches(e, '(?s)' || {_BEFORE} || regexp_escape(t) || {_AFTER})""",
)
def first_places(spark: SparkSession, d: str) -> DataFrame:
    rows = triples(spark, d).where("evidence is not null and subject <> ''")
    return rows.select("triple_id", matching.first_place(F.lower("evidence"), F.lower("subject")).alias("place")).where("place is not null")


@query("status_store", "SELECT 'doc_' || d.doc_id AS doc_key, count(DISTINCT c.chunk_uid) > 0 AS done FROM documents d LEFT JOIN chunks c ON c.doc_id = 'doc_' || d.doc_id GROUP BY 1")
def status_store(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("doc_key")).distinct()
    done = table(spark, d, "chunks").select(F.col("doc_id").alias("doc_key"), F.lit(True).alias("done")).distinct()
    return docs.join(done, "doc_key", "left").select("doc_key", F.coalesce("done", F.lit(False)).alias("done"))
