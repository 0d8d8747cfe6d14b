"""Queries of the evaluation marts: faithfulness, recall, distributions, rollups, agreement, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as T
from ..operators import metrics as M
from ..sources.tables import table
from .base import SQL_CANDIDATES, SQL_ENTITIES, SQL_EVERY_TRIPLE, SQL_OUTCOMES, SQL_RESULTS, SQL_TRIPLES, candidates, entities, every_triple, outcomes, results, rnd, sq, triples, words
from .text_queries import _ENDS, _VERDICT, STATEMENT

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, judge_model, outcome_id, verdict): the document comes from the request id."""
    v = A.verdict(F.col("verdict"))
    return outcomes(spark, d).select(F.get(F.split("custom_id", r"\|"), F.lit(1)).alias("doc_id"), "judge_model", "outcome_id", v.alias("verdict"))


SQL_VERDICTS = f"(SELECT string_split(custom_id, '|')[2] AS doc_id, judge_model, outcome_id, {_VERDICT} AS verdict FROM (SELECT *, translate(upper({_ENDS.format('verdict')}), '- ', '__') AS v FROM {SQL_OUTCOMES}))"
_COUNTS = """count(*) AS n_total, count(*) FILTER (WHERE verdict = 'MALFORMED') AS n_malformed, count(*) FILTER (WHERE verdict = 'JUDGE_ERROR') AS n_judge_error,
count(*) FILTER (WHERE verdict = 'SUPPORTED') AS n_supported, count(*) FILTER (WHERE verdict NOT IN ('MALFORMED', 'JUDGE_ERROR')) AS n_evaluated"""
_PER_DOC = f"(SELECT doc_id, judge_model, {_COUNTS} FROM {SQL_VERDICTS} GROUP BY 1, 2)"
_RATE = "CASE WHEN n_evaluated > 0 THEN n_supported::DOUBLE / n_evaluated ELSE 0 END"


def audit(spark: SparkSession, d: str) -> DataFrame:
    """Every triple with its statement and verdict, by left joins on the request ids of its document and place.

    A triple with a missing or blank part is MALFORMED and has no statement; the statement is the last stored one, else
    the template; the last stored judgement counts, and without one the verdict is JUDGE_ERROR.
    """
    s, r, o = (F.col(c) for c in ("subject", "relation", "object"))
    bad = T.malformed(s, r, o)
    place = lambda op: F.concat_ws("|", F.lit(op), "doc_id", F.col("triple_ord").cast("string"))
    told = table(spark, d, "batch_results").where("custom_id like 'statement|%' and success and content is not null")
    told = told.groupBy(F.col("custom_id").alias("s_id")).agg(F.max(F.struct("finished_at", "result_id", "content"))["content"].alias("told"))
    said = table(spark, d, "judge_outcomes").groupBy(F.col("custom_id").alias("j_id")).agg(F.max(F.struct("judged_at", "outcome_id", "verdict", "judge_model")).alias("j"))
    rows = every_triple(spark, d).select("triple_id", "doc_id", "pipeline", *A.ALIASES, place("statement").alias("s_id"), place("judge").alias("j_id"))
    rows = rows.join(told, "s_id", "left").join(said, "j_id", "left")
    statement = F.when(~bad, F.coalesce(T.parsed_statement(F.col("told")), T.templated(s, r, o)))
    return rows.select("triple_id", "doc_id", "pipeline", statement.alias("statement"), F.when(bad, "MALFORMED").otherwise(A.verdict(F.col("j.verdict"))).alias("verdict"), "j.judge_model")


_TOLD = "SELECT custom_id, arg_max(content, (finished_at, result_id)) AS told FROM batch_results WHERE custom_id LIKE 'statement|%' AND success AND content IS NOT NULL GROUP BY 1"
_SAID = "SELECT custom_id, last(verdict ORDER BY judged_at, outcome_id) AS verdict, last(judge_model ORDER BY judged_at, outcome_id) AS judge_model FROM judge_outcomes GROUP BY 1"
_BAD = " OR ".join(f"coalesce({sq(x)}, '') = ''" for x in A.ALIASES)
SQL_AUDIT = f"""(SELECT triple_id, doc_id, pipeline, CASE WHEN NOT bad THEN coalesce({STATEMENT.format('told')}, {' || '.join([sq('subject'), "' '", sq('relation'), "' '", sq('object'), "'.'"])}) END AS statement,
CASE WHEN bad THEN 'MALFORMED' ELSE {_VERDICT} END AS verdict, judge_model FROM (SELECT t.*, {_BAD} AS bad, told, translate(upper({_ENDS.format('j.verdict')}), '- ', '__') AS v, judge_model FROM {SQL_EVERY_TRIPLE} t
LEFT JOIN ({_TOLD}) s ON s.custom_id = 'statement|' || doc_id || '|' || triple_ord LEFT JOIN ({_SAID}) j ON j.custom_id = 'judge|' || doc_id || '|' || triple_ord))"""
_AUDIT_DOCS = f"(SELECT doc_id, pipeline, {_COUNTS} FROM {SQL_AUDIT} GROUP BY 1, 2)"


@query("audit_chain", f"SELECT * FROM {SQL_AUDIT}")
def audit_chain(spark: SparkSession, d: str) -> DataFrame:
    return audit(spark, d)


@query("faithfulness_per_doc", f"SELECT *, round({_RATE}, 6) AS rate FROM {_AUDIT_DOCS}")
def faithfulness_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return M.faithfulness_per_doc(audit(spark, d), ["doc_id", "pipeline"]).withColumn("rate", rnd("rate"))


@query("judge_rates", f"SELECT *, round({_RATE}, 6) AS rate FROM {_PER_DOC}")
def judge_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates per document and judge over all stored judgements."""
    return M.faithfulness_per_doc(verdicts(spark, d), ["doc_id", "judge_model"]).withColumn("rate", rnd("rate"))


@query(
    "faithfulness_dataset",
    f"""SELECT pipeline, count(*) AS n_docs, sum(n_total)::BIGINT AS n_total, sum(n_evaluated)::BIGINT AS n_evaluated, sum(n_supported)::BIGINT AS n_supported, round(avg(rate) FILTER (WHERE n_evaluated > 0), 6) AS macro,
round(coalesce(stddev_pop(rate) FILTER (WHERE n_evaluated > 0), 0), 6) AS macro_std, round(sum(n_supported) / sum(n_evaluated), 6) AS micro FROM (SELECT *, {_RATE} AS rate FROM {_AUDIT_DOCS}) GROUP BY 1""",
)
def faithfulness_dataset(spark: SparkSession, d: str) -> DataFrame:
    df = M.faithfulness_dataset(M.faithfulness_per_doc(audit(spark, d), ["doc_id", "pipeline"]), ["pipeline"])
    return df.withColumns({c: rnd(c) for c in ("macro", "macro_std", "micro")})


@query("request_results", "SELECT custom_id, CASE WHEN r.custom_id IS NULL THEN 'missing' WHEN ok THEN 'answered' ELSE 'failed' END AS state FROM (SELECT 'summary|doc_' || doc_id || '|' || n AS custom_id FROM documents, (SELECT unnest(range(3)) AS n)) q LEFT JOIN (SELECT custom_id, bool_or(success AND content IS NOT NULL) AS ok FROM batch_results GROUP BY 1) r USING (custom_id)")
def request_results(spark: SparkSession, d: str) -> DataFrame:
    """Requests for three summaries of each document against their answers; failed and missing ones are to be asked again."""
    asked = table(spark, d, "documents").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda n: F.concat_ws("|", F.lit("summary"), F.concat(F.lit("doc_"), "doc_id"), n.cast("string")))).alias("custom_id"))
    ok = table(spark, d, "batch_results").groupBy("custom_id").agg(F.bool_or(F.col("success") & F.col("content").isNotNull()).alias("ok"), F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "missing").when(F.col("ok"), "answered").otherwise("failed")
    return asked.join(ok, "custom_id", "left").select("custom_id", state.alias("state"))


@query("recall_accuracy", f"SELECT pipeline, count(*) AS n_docs, round(100 * avg(p), 6) AS macro, round(100.0 * sum(hits) / sum(n), 6) AS micro FROM (SELECT t.doc_id, t.pipeline, count(*) FILTER (WHERE v.verdict = 'SUPPORTED') AS hits, count(*) AS n, hits / n AS p FROM (SELECT DISTINCT doc_id, pipeline FROM {SQL_TRIPLES}) t JOIN {SQL_VERDICTS} v USING (doc_id) GROUP BY 1, 2) GROUP BY 1")
def recall_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Share of judged facts that the graph of a pipeline supports: per document and over all; a failed judgement counts as a miss."""
    docs = triples(spark, d).select("doc_id", "pipeline").distinct()
    per = docs.join(verdicts(spark, d), "doc_id").groupBy("doc_id", "pipeline").agg(F.count_if(F.col("verdict") == "SUPPORTED").alias("hits"), F.count("*").alias("n"))
    return per.groupBy("pipeline").agg(F.count("*").alias("n_docs"), rnd(100 * F.avg(F.col("hits") / F.col("n"))).alias("macro"), rnd(100 * F.sum("hits") / F.sum("n")).alias("micro"))


@query("single_multi_split", f"""SELECT coalesce(class, 'overall') AS class, count(*) AS n, count(*) FILTER (WHERE verdict = 'SUPPORTED') AS n_hit, round(100.0 * count(*) FILTER (WHERE verdict = 'SUPPORTED') / count(*), 6) AS percent
FROM (SELECT v.verdict, CASE WHEN e.k = 1 THEN 'single' ELSE 'multi' END AS class FROM {SQL_VERDICTS} v LEFT JOIN (SELECT doc_id, count(DISTINCT ent_type) AS k FROM {SQL_ENTITIES} GROUP BY 1) e USING (doc_id)) GROUP BY ROLLUP (class)""")
def single_multi_split(spark: SparkSession, d: str) -> DataFrame:
    """Hits by class of the document, and over all; what has no class counts as multi."""
    classes = entities(spark, d).groupBy("doc_id").agg(F.count_distinct("ent_type").alias("k"))
    df = verdicts(spark, d).join(classes, "doc_id", "left").withColumn("class", F.when(F.col("k") == 1, "single").otherwise("multi"))
    out = df.rollup("class").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "SUPPORTED").alias("n_hit"))
    return out.select(F.coalesce("class", F.lit("overall")).alias("class"), "n", "n_hit", rnd(100 * F.col("n_hit") / F.col("n")).alias("percent"))


@query(
    "resolution_rollup",
    f"SELECT coalesce(pipeline, 'all') AS pipeline, coalesce(origin, 'all') AS origin, count(*) AS n, count(*) FILTER (WHERE evidence IS NOT NULL) AS n_evidence, round(100.0 * n_evidence / n, 6) AS percent FROM (SELECT coalesce(pipeline, '-') AS pipeline, coalesce(origin, '-') AS origin, evidence FROM {SQL_TRIPLES}) GROUP BY GROUPING SETS ((pipeline, origin), (pipeline), (origin), ())",
)
def resolution_rollup(spark: SparkSession, d: str) -> DataFrame:
    df = triples(spark, d).select(F.coalesce("pipeline", F.lit("-")).alias("pipeline"), F.coalesce("origin", F.lit("-")).alias("origin"), "evidence")
    sets = df.groupingSets([["pipeline", "origin"], ["pipeline"], ["origin"], []], "pipeline", "origin").agg(F.count("*").alias("n"), F.count("evidence").alias("n_evidence"))
    return sets.select(F.coalesce("pipeline", F.lit("all")).alias("pipeline"), F.coalesce("origin", F.lit("all")).alias("origin"), "n", "n_evidence", rnd(100 * F.col("n_evidence") / F.col("n")).alias("percent"))


@query("resolution_counts")
def resolution_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per pipeline: the nine counters of the object resolution, and their ratios."""
    from .flow_queries import QUERIES as FLOW

    done = FLOW["resolution_history"](spark, d).select("triple_id", "status", "method", F.size("after").alias("n_after"))
    return M.resolution_counters(done.join(triples(spark, d).select("triple_id", "pipeline"), "triple_id"), ["pipeline"])


@query("verification_counts", f"""SELECT pipeline, count(*) AS n, count(*) FILTER (WHERE status = 'valid') AS valid, count(*) FILTER (WHERE status = 'fixed') AS fixed, count(*) FILTER (WHERE status = 'discarded') AS discarded FROM (
SELECT pipeline, CASE WHEN NOT (contains(lower(relation), lower(subject)) OR contains(lower(relation), lower(object))) THEN 'valid' WHEN origin IN ('fixed', 'repaired') THEN 'fixed' ELSE 'discarded' END AS status FROM {SQL_TRIPLES}) GROUP BY 1""")
def verification_counts(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.resolve import valid_relation

    ok = valid_relation(F.col("subject"), F.col("relation"), F.col("object"))
    status = F.when(ok, "valid").when(F.col("origin").isin("fixed", "repaired"), "fixed").otherwise("discarded")
    return triples(spark, d).select("pipeline", status.alias("s")).groupBy("pipeline").agg(F.count("*").alias("n"), *(F.count_if(F.col("s") == x).alias(x) for x in ("valid", "fixed", "discarded")))


@query("entity_frequency", f"SELECT doc_id, lower({sq('name')}) AS entity, count(*) AS n FROM {SQL_ENTITIES} GROUP BY 1, 2")
def entity_frequency(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import clean_relation

    return entities(spark, d).groupBy("doc_id", clean_relation(F.col("name")).alias("entity")).agg(F.count("*").alias("n"))


@query("triple_stats", f"SELECT pipeline, count(*) AS n, count(DISTINCT subject) AS n_subjects, count(DISTINCT relation) AS n_relations, count(DISTINCT object) AS n_objects, count(evidence) AS n_evidence FROM {SQL_TRIPLES} GROUP BY 1")
def triple_stats(spark: SparkSession, d: str) -> DataFrame:
    return triples(spark, d).groupBy("pipeline").agg(F.count("*").alias("n"), *(F.count_distinct(c).alias(f"n_{c}s") for c in ("subject", "relation", "object")), F.count("evidence").alias("n_evidence"))


_DIST = "count({0}) AS n, round(avg({0}), 6) AS mean, round(median({0}), 6) AS median, round(coalesce(stddev_samp({0}), 0), 6) AS std_sample, round(coalesce(stddev_pop({0}), 0), 6) AS std_population, min({0}) AS min, max({0}) AS max"


@query("score_distribution", f"SELECT source, collection, {_DIST.format('v')} FROM (SELECT source, collection, {words('text')}::DOUBLE AS v FROM documents) GROUP BY 1, 2")
def score_distribution(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import word_count

    df = table(spark, d, "documents").select("source", "collection", word_count(F.col("text")).cast("double").alias("v"))
    return M.distribution(df, ["source", "collection"], "v").withColumns({c: rnd(c) for c in ("mean", "median", "std_sample", "std_population")})


@query("accuracy_bands", f"SELECT judge_model, CASE WHEN p < 25 THEN 0 WHEN p < 50 THEN 1 WHEN p < 75 THEN 2 ELSE 3 END::INT AS band, count(*) AS n FROM (SELECT judge_model, 100 * {_RATE} AS p FROM {_PER_DOC}) GROUP BY 1, 2")
def accuracy_bands(spark: SparkSession, d: str) -> DataFrame:
    df = M.faithfulness_per_doc(verdicts(spark, d), ["doc_id", "judge_model"])
    return df.select("judge_model", M.band(100 * F.col("rate")).alias("band")).groupBy("judge_model", "band").agg(F.count("*").alias("n"))


@query(
    "pairwise_runs",
    f"""WITH p AS (SELECT doc_id, judge_model, {_RATE} AS r FROM {_PER_DOC})
SELECT x.judge_model AS run_a, y.judge_model AS run_b, count(*) AS n, round(avg(x.r - y.r), 6) AS mean_diff, count(*) FILTER (WHERE x.r > y.r) AS wins, count(*) FILTER (WHERE x.r < y.r) AS losses, count(*) FILTER (WHERE x.r = y.r) AS ties
FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.judge_model < y.judge_model GROUP BY 1, 2""",
)
def pairwise_runs(spark: SparkSession, d: str) -> DataFrame:
    p = M.faithfulness_per_doc(verdicts(spark, d), ["doc_id", "judge_model"]).select("doc_id", "judge_model", "rate")
    both = p.toDF("doc_id", "run_a", "a").join(p.toDF("doc_id", "run_b", "b"), "doc_id").where("run_a < run_b")
    return both.groupBy("run_a", "run_b").agg(F.count("*").alias("n"), rnd(F.avg(F.col("a") - F.col("b"))).alias("mean_diff"), F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("a") < F.col("b")).alias("losses"), F.count_if(F.col("a") == F.col("b")).alias("ties"))


@query("consistency", f"SELECT judge_model, CASE WHEN s < 15 THEN 'consistent' WHEN s < 20 THEN 'moderate' ELSE 'variable' END AS class, rank() OVER (ORDER BY m DESC)::INT AS place FROM (SELECT judge_model, coalesce(stddev_pop(100 * {_RATE}), 0) AS s, round(avg({_RATE}), 6) AS m FROM {_PER_DOC} GROUP BY 1)")
def consistency(spark: SparkSession, d: str) -> DataFrame:
    """Runs by mean, a handful of rows after the aggregate, and how even they are."""
    per = M.faithfulness_per_doc(verdicts(spark, d), ["doc_id", "judge_model"])
    agg = per.groupBy("judge_model").agg(F.coalesce(F.stddev_pop(100 * F.col("rate")), F.lit(0.0)).alias("s"), rnd(F.avg("rate")).alias("m"))
    return agg.select("judge_model", M.consistency(F.col("s")).alias("class"), F.rank().over(Window.orderBy(F.desc("m"))).alias("place"))


@query("fact_set_stats", f"""WITH f AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE error IS NULL AND NOT coalesce(span_mismatch, true)) AS kept FROM {SQL_CANDIDATES} GROUP BY 1)
SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_candidates, sum(kept)::BIGINT AS n_kept, round(avg(kept / n), 6) AS mean_rate, round(coalesce(stddev_samp(kept / n), 0), 6) AS std_rate, round(avg(kept), 6) AS mean_kept, min(kept) AS min_kept, max(kept) AS max_kept FROM f""")
def fact_set_stats(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("error").isNull() & ~F.coalesce("span_mismatch", F.lit(True))
    f = candidates(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("kept"))
    r = F.col("kept") / F.col("n")
    return f.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_candidates"), F.sum("kept").alias("n_kept"), rnd(F.avg(r)).alias("mean_rate"), rnd(F.coalesce(F.stddev_samp(r), F.lit(0.0))).alias("std_rate"), rnd(F.avg("kept")).alias("mean_kept"), F.min("kept").alias("min_kept"), F.max("kept").alias("max_kept"))


_LABELS = f"(SELECT outcome_id, {_VERDICT} AS a, CASE WHEN contains(upper(raw_content), 'NOT_S') OR contains(upper(raw_content), 'CONTRAD') THEN 'NOT_SUPPORTED' WHEN contains(upper(raw_content), 'SUPPORTED') THEN 'SUPPORTED' ELSE 'JUDGE_ERROR' END AS b FROM (SELECT *, translate(upper({_ENDS.format('verdict')}), '- ', '__') AS v FROM {SQL_OUTCOMES}))"


def labels(spark: SparkSession, d: str) -> DataFrame:
    """Two labels of each outcome: the stored verdict, and a reading of the raw answer."""
    raw = F.upper("raw_content")
    b = F.when(F.contains(raw, F.lit("NOT_S")) | F.contains(raw, F.lit("CONTRAD")), "NOT_SUPPORTED").when(F.contains(raw, F.lit("SUPPORTED")), "SUPPORTED").otherwise("JUDGE_ERROR")
    return outcomes(spark, d).select("outcome_id", A.verdict(F.col("verdict")).alias("a"), b.alias("b"))


@query("kappa", f"WITH l AS {_LABELS}, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS same FROM l), e AS (SELECT sum(x * y) AS xy FROM (SELECT a, count(*) AS x FROM l GROUP BY 1) JOIN (SELECT b AS a, count(*) AS y FROM l GROUP BY 1) USING (a)) SELECT n, round(same / n, 6) AS accuracy, round((same / n - xy / (n * n)) / (1 - xy / (n * n)), 6) AS kappa FROM t, e")
def kappa(spark: SparkSession, d: str) -> DataFrame:
    return M.kappa(labels(spark, d), "a", "b").withColumns({c: rnd(c) for c in ("accuracy", "kappa")})


@query("confusion", f"SELECT a, b, count(*) AS n, round(n / sum(n) OVER (PARTITION BY b), 6) AS precision_of_b, round(n / sum(n) OVER (PARTITION BY a), 6) AS recall_of_a FROM {_LABELS} GROUP BY 1, 2")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    c = labels(spark, d).groupBy("a", "b").agg(F.count("*").alias("n"))
    share = lambda k: rnd(F.col("n") / F.sum("n").over(Window.partitionBy(k)))
    return c.select("a", "b", "n", share("b").alias("precision_of_b"), share("a").alias("recall_of_a"))


@query("relation_entropy", f"WITH c AS (SELECT doc_id, relation, count(*) AS c FROM {SQL_TRIPLES} GROUP BY 1, 2) SELECT doc_id, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy FROM c GROUP BY 1")
def relation_entropy(spark: SparkSession, d: str) -> DataFrame:
    return M.entropy(triples(spark, d), ["doc_id"], "relation").withColumn("entropy", rnd("entropy"))


@query(
    "correlations",
    f"""WITH b AS (SELECT pipeline, doc_id, count(*)::DOUBLE AS x, count(DISTINCT relation)::DOUBLE AS y FROM {SQL_TRIPLES} GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY pipeline ORDER BY x) + (count(*) OVER (PARTITION BY pipeline, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY pipeline ORDER BY y) + (count(*) OVER (PARTITION BY pipeline, y) - 1) / 2 AS ry FROM b)
SELECT pipeline, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1""",
)
def correlations(spark: SparkSession, d: str) -> DataFrame:
    b = triples(spark, d).groupBy("pipeline", "doc_id").agg(F.count("*").cast("double").alias("x"), F.count_distinct("relation").cast("double").alias("y"))
    return M.correlations(b, ["pipeline"], "x", "y").select("pipeline", "n", rnd("pearson").alias("pearson"), rnd("spearman").alias("spearman"))


@query("correlation_tests")
def correlation_tests(spark: SparkSession, d: str) -> DataFrame:
    b = triples(spark, d).groupBy("pipeline", "doc_id").agg(F.count("*").cast("double").alias("x"), F.count_distinct("relation").cast("double").alias("y"))
    return M.correlations(b, ["pipeline"], "x", "y").where("n >= 5").orderBy(F.desc(F.abs("spearman")))


@query("kde_curve", """WITH b AS (SELECT event_type, round(value / 0.5) AS b, count(*) AS n FROM events GROUP BY 1, 2), g AS (SELECT unnest([0.0, 10.0, 20.0, 30.0, 40.0])::DOUBLE AS x)
SELECT event_type, x, round(sum(n * exp(-1 * pow((x - b * 0.5) / 5.0, 2) / 2)) / (sum(n) * 5.0 * sqrt(2 * pi())), 6) AS density FROM b, g GROUP BY 1, 2""")
def kde_curve(spark: SparkSession, d: str) -> DataFrame:
    return M.kde(table(spark, d, "events"), ["event_type"], "value", [0, 10, 20, 30, 40], 5.0).withColumn("density", rnd("density"))


@query("model_means", f"SELECT provider, round(avg(length(content)), 6) AS mean_chars, round(avg(status_code), 6) AS mean_status, count(*) AS n FROM {SQL_RESULTS} GROUP BY 1")
def model_means(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).groupBy("provider").agg(rnd(F.avg(F.length("content"))).alias("mean_chars"), rnd(F.avg("status_code")).alias("mean_status"), F.count("*").alias("n"))


def log_text() -> F.Column:
    return F.concat(F.lit("x | DEBUG | ["), F.col("event_type"), F.lit("] Tokens - Input: "), F.get_json_object("props", "$.k"), F.lit(", Output: "), F.col("user_id").cast("string"))


@query("token_scan", "SELECT event_type AS provider, count(*) AS n_calls, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS n_in, sum(user_id)::BIGINT AS n_out FROM events GROUP BY 1")
def token_scan(spark: SparkSession, d: str) -> DataFrame:
    logs = table(spark, d, "events").select("event_id", log_text().alias("line"))
    return M.token_lines(logs, ["event_id"], "line").groupBy("provider").agg(F.count("*").alias("n_calls"), F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))


@query("token_rollup", "SELECT coalesce(event_type, 'all') AS provider, coalesce(user_id, -1) AS experiment, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS n_in FROM events GROUP BY ROLLUP (event_type, user_id)")
def token_rollup(spark: SparkSession, d: str) -> DataFrame:
    logs = table(spark, d, "events").select("user_id", log_text().alias("line"))
    out = M.token_lines(logs, ["user_id"], "line").rollup("provider", "user_id").agg(F.sum("n_in").alias("n_in"))
    return out.select(F.coalesce("provider", F.lit("all")).alias("provider"), F.coalesce("user_id", F.lit(-1)).alias("experiment"), "n_in")


@query(
    "token_avg_rectangular",
    f"""WITH a AS (SELECT DISTINCT pipeline FROM {SQL_TRIPLES}), c AS (SELECT DISTINCT collection FROM documents),
t AS (SELECT pipeline, collection, sum(length(subject) + length(object))::DOUBLE AS s, count(DISTINCT t.doc_id) AS n FROM {SQL_TRIPLES} t JOIN documents d ON t.doc_id = 'doc_' || d.doc_id GROUP BY 1, 2)
SELECT a.pipeline, c.collection, round(s / n, 6) AS mean FROM a CROSS JOIN c LEFT JOIN t ON t.pipeline = a.pipeline AND t.collection = c.collection""",
)
def token_avg_rectangular(spark: SparkSession, d: str) -> DataFrame:
    """A full table of pipelines by collections, cells without documents null: both sides are a few distinct names."""
    t = triples(spark, d)
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("doc_id"), "collection")
    cells = t.join(docs, "doc_id").groupBy("pipeline", "collection").agg((F.sum(F.length("subject") + F.length("object")) / F.count_distinct("doc_id")).alias("mean"))
    frame = t.select("pipeline").distinct().crossJoin(docs.select("collection").distinct())
    return frame.join(cells, ["pipeline", "collection"], "left").select("pipeline", "collection", rnd("mean").alias("mean"))


@query("fuzzy_scores")
def fuzzy_scores(spark: SparkSession, d: str) -> DataFrame:
    """Fuzzy and combined scores of the proposed entity pairs."""
    names = entities(spark, d).select("doc_id", "ent_key", "name")
    pairs = table(spark, d, "candidate_pairs").select("doc_id", "ent_a", "ent_b", "sim").distinct()
    both = pairs.join(names.toDF("doc_id", "ent_a", "x"), ["doc_id", "ent_a"]).join(names.toDF("doc_id", "ent_b", "y"), ["doc_id", "ent_b"])
    both = both.withColumn("fuzzy", M.fuzzy_score(F.col("x"), F.col("y")))
    return both.select("doc_id", "ent_a", "ent_b", "sim", "fuzzy", M.combined_score(F.col("fuzzy"), F.col("sim")).alias("combined"))


@query("combined_score", "SELECT doc_id, ent_a, ent_b, round(CASE WHEN sim > 0 THEN 1 / ((0.4 + 0.3 / (1 + exp(-20 * (sim - 0.8)))) / sim + (1 - (0.4 + 0.3 / (1 + exp(-20 * (sim - 0.8))))) / 0.5) ELSE 0 END, 6) AS combined FROM (SELECT DISTINCT doc_id, ent_a, ent_b, sim FROM candidate_pairs) ")
def combined_score(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "candidate_pairs").select("doc_id", "ent_a", "ent_b", "sim").distinct()
    return pairs.select("doc_id", "ent_a", "ent_b", rnd(M.combined_score(F.lit(0.5), F.col("sim"))).alias("combined"))


@query("redundancy_by_doc", "SELECT doc_id, count(*) AS n_pairs, round(avg(sim), 6) AS mean, max(sim) AS max, min(sim) AS min, round(stddev_pop(sim), 6) AS std, count(*) FILTER (WHERE sim >= 0.75) AS n_redundant, round(1 - avg(sim), 6) AS entity_uir FROM (SELECT DISTINCT doc_id, ent_a, ent_b, sim FROM candidate_pairs WHERE sim IS NOT NULL) GROUP BY 1")
def redundancy_by_doc(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "candidate_pairs").select("doc_id", "ent_a", "ent_b", "sim").where("sim is not null").distinct()
    return p.groupBy("doc_id").agg(F.count("*").alias("n_pairs"), rnd(F.avg("sim")).alias("mean"), F.max("sim").alias("max"), F.min("sim").alias("min"), rnd(F.stddev_pop("sim")).alias("std"), F.count_if(F.col("sim") >= 0.75).alias("n_redundant"), rnd(1 - F.avg("sim")).alias("entity_uir"))


@query("top_redundant_pairs", "SELECT doc_id, ent_a, ent_b, sim FROM (SELECT DISTINCT doc_id, ent_a, ent_b, sim FROM candidate_pairs WHERE sim IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, ent_a, ent_b) <= 10")
def top_redundant_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar pairs of each document; the ten are the feature."""
    p = table(spark, d, "candidate_pairs").select("doc_id", "ent_a", "ent_b", "sim").where("sim is not null").distinct()
    w = Window.partitionBy("doc_id").orderBy(F.desc("sim"), "ent_a", "ent_b")
    return p.withColumn("k", F.row_number().over(w)).where("k <= 10").drop("k")


@query(
    "run_extremes",
    f"""WITH p AS (SELECT doc_id, judge_model, {_RATE} AS r FROM {_PER_DOC})
SELECT x.judge_model AS run_a, y.judge_model AS run_b, max(x.r - y.r) AS best_diff, arg_min(x.doc_id, (y.r - x.r, x.doc_id)) AS best_doc, arg_min(x.doc_id, (x.r - y.r, x.doc_id)) AS worst_doc FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.judge_model < y.judge_model GROUP BY 1, 2""",
)
def run_extremes(spark: SparkSession, d: str) -> DataFrame:
    """The documents with the greatest difference either way, the smaller id on ties."""
    p = M.faithfulness_per_doc(verdicts(spark, d), ["doc_id", "judge_model"]).select("doc_id", "judge_model", "rate")
    both = p.toDF("doc_id", "run_a", "a").join(p.toDF("doc_id", "run_b", "b"), "doc_id").where("run_a < run_b").withColumn("diff", F.col("a") - F.col("b"))
    low = lambda c: F.min(F.struct(c.alias("d"), "doc_id"))["doc_id"]
    return both.groupBy("run_a", "run_b").agg(F.max("diff").alias("best_diff"), low(-F.col("diff")).alias("best_doc"), low(F.col("diff")).alias("worst_doc"))


@query("arm_summary", "SELECT CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS arm, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1, 2")
def arm_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean and population deviation of each arm of a comparison; the arms are the two halves of the ids."""
    arm = F.when(F.col("event_id") % 2 == 0, "a").otherwise("b")
    return table(spark, d, "events").groupBy(arm.alias("arm"), "event_type").agg(F.count("*").alias("n"), rnd(F.avg("value")).alias("mean"), rnd(F.stddev_pop("value")).alias("std"))
