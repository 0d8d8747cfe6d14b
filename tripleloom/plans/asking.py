"""Model-backed stages: requests with repair and retry, judges, facts, relations, resolution of pairs, batch jobs.

Every stage builds prompts, asks a backend through `complete` or `ask_json`, and checks the answers with column
expressions. A failed or unusable answer has a stated outcome, so no row is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.answers import answer_triples, category, inner_relation, json_body, verdict
from ..functions.text import blank_to_null, clean_entity, clean_relation, malformed, squeeze, templated
from ..operators.resolve import valid_relation
from ..operators.segment import rule_sentences
from ..operators.vectors import dot
from ..session import cut, partitions
from ..sources.files import write_requests
from .backends import HashedEmbedder, RuleBackend, complete, embedded, ends_asked

STRICT = "\n\nAnswer with valid JSON only."

#: Relations of a document up to which one task takes them all; n times as many are dealt to about the root of n tasks, as each of them gets all names of the document.
PART = 5000


def prompt(task: str, **parts) -> Column:
    """A task line, a blank line, and the parts as one JSON object."""
    return F.concat(F.lit(task + "\n\n"), F.to_json(F.struct(*(c.alias(k) for k, c in parts.items())), {"ignoreNullFields": "false"}))


def parses(text: Column) -> Column:
    """Whether an answer holds JSON."""
    return F.try_parse_json(blank_to_null(json_body(text))).isNotNull()


def ask_json(df: DataFrame, prompt: str, answer: str, backend=RuleBackend) -> DataFrame:
    """Adds answers that hold JSON, null where none came.

    An answer that does not parse is sent back once for repair, an empty one is not; what still does not parse is asked
    a second time under a strict request. Only the rows that failed take part in each step.
    """
    keys = df.select(prompt).where(F.col(prompt).isNotNull()).distinct()
    first = cut(complete(keys, prompt, "_a", backend))
    bad = first.where(~F.coalesce(parses(F.col("_a")), F.lit(False)))
    broken = bad.where(F.coalesce(squeeze(F.col("_a")), F.lit("")) != "").withColumn("_again", F.concat(F.lit("Repair the JSON.\n\n"), "_a"))
    mended = cut(complete(broken.select(prompt, "_again"), "_again", "_r", backend).where(F.coalesce(parses(F.col("_r")), F.lit(False))).select(prompt, "_r"))
    again = bad.join(mended.select(prompt), prompt, "left_anti").select(prompt, F.concat(F.col(prompt), F.lit(STRICT)).alias("_again"))
    second = complete(again, "_again", "_s", backend).where(F.coalesce(parses(F.col("_s")), F.lit(False))).select(prompt, "_s")
    good = F.when(parses(F.col("_a")), F.col("_a"))
    got = first.join(mended, prompt, "left").join(second, prompt, "left").select(prompt, F.coalesce(good, "_r", "_s").alias(answer))
    return df.join(got, prompt, "left")


def _field(answer: str, *names: str) -> Column:
    v = F.try_parse_json(json_body(F.col(answer)))
    return F.coalesce(*(F.try_variant_get(v, f"$.{n}", "string") for n in names))


# ---- statements and judges ------------------------------------------------------------------------


def verbalised(triples: DataFrame, backend=RuleBackend) -> DataFrame:
    """Adds `statement`: the model's first line, the template where it fails, null for malformed triples."""
    s, r, o = (F.col(c) for c in ("subject", "relation", "object"))
    rows = triples.withColumn("_p", F.when(~malformed(s, r, o), prompt("State the triple in one sentence.", subject=squeeze(s), relation=squeeze(r), object=squeeze(o))))
    from ..functions.text import parsed_statement

    asked = complete(rows, "_p", "_a", backend)
    return asked.withColumn("statement", F.when(F.col("_p").isNotNull(), F.coalesce(parsed_statement(F.col("_a")), templated(s, r, o)))).drop("_p", "_a")


def judged(rows: DataFrame, statement: str = "statement", context: str = "context", backend=RuleBackend) -> DataFrame:
    """Adds `verdict`: MALFORMED without a statement, else SUPPORTED or NOT_SUPPORTED, JUDGE_ERROR after one retry."""
    rows = rows.withColumn("_p", F.when(F.col(statement).isNotNull(), prompt("Judge whether the context supports the statement.", statement=F.col(statement), context=F.coalesce(context, F.lit("")))))
    asked = ask_json(rows, "_p", "_a", backend)
    said = verdict(_field("_a", "verdict", "answer", "label"))
    return asked.withColumn("verdict", F.when(F.col("_p").isNull(), "MALFORMED").otherwise(said)).drop("_p", "_a")


def recalled(rows: DataFrame, fact: str = "fact", context: str = "context", backend=RuleBackend) -> DataFrame:
    """Adds `hit`, 1 or 0: whether the context of a graph states a gold fact; a second failure counts as 0."""
    from ..functions.answers import binary_verdict

    ask = prompt("Answer 1 if the context states the fact, else 0.", fact=F.col(fact), context=F.coalesce(context, F.lit("")))
    rows = complete(rows.withColumn("_p", ask), "_p", "_a", backend)
    bad = cut(rows.where(binary_verdict(F.col("_a")).isNull()).select(F.col("_p").alias("_q")).distinct().withColumn("_p2", F.concat("_q", F.lit(STRICT))))
    second = complete(bad, "_p2", "_b", backend).select(F.col("_q").alias("_p"), "_b")
    return rows.join(second, "_p", "left").withColumn("hit", F.coalesce(binary_verdict(F.col("_a")), binary_verdict(F.col("_b")), F.lit(0))).drop("_p", "_a", "_b")


# ---- facts ----------------------------------------------------------------------------------------


def contained(span: Column, text: Column) -> Column:
    """Whether a span that is not blank stands in a text, case and blanks aside."""
    s = F.lower(squeeze(span))
    return F.coalesce((s != "") & F.contains(F.lower(squeeze(text)), s), F.lit(False))


def generated_facts(docs: DataFrame, most: int = 15, backend=RuleBackend) -> DataFrame:
    """(doc_id, fact_ord, fact, supporting_span, span_mismatch, error): at most `most` facts a text, the first ones; a text whose answer fails gives one row with an error."""
    asked = ask_json(docs.withColumn("_p", F.concat(F.lit("Write atomic facts of the text.\n\n"), "text")), "_p", "_a", backend)
    items = F.try_variant_get(F.try_parse_json(json_body(F.col("_a"))), "$.facts", "array<struct<fact:string,supporting_span:string>>")
    rows = asked.select("doc_id", "text", F.posexplode_outer(F.slice(F.coalesce(items, F.array().cast("array<struct<fact:string,supporting_span:string>>")), 1, most)).alias("fact_ord", "f"))
    failed = F.when(F.col("f.fact").isNull(), "no facts in the answer")
    mismatch = F.when(F.col("f.fact").isNotNull(), ~contained(F.col("f.supporting_span"), F.col("text")))
    return rows.select("doc_id", F.coalesce("fact_ord", F.lit(0)).alias("fact_ord"), "f.fact", "f.supporting_span", mismatch.alias("span_mismatch"), failed.alias("error"))


def verified_facts(facts: DataFrame, context: str = "context", backend=RuleBackend) -> DataFrame:
    """Adds `verifier_verdict` (SUPPORTED, CONTRADICTED, NOT_STATED or what else was said), null where the answer failed."""
    asked = ask_json(facts.withColumn("_p", F.when(F.col("fact").isNotNull(), prompt("Verify the fact against the text.", fact=F.col("fact"), text=F.col(context)))), "_p", "_a", backend)
    said = blank_to_null(F.translate(F.upper(squeeze(_field("_a", "verdict"))), "- ", "__"))
    return asked.withColumn("verifier_verdict", said).drop("_p", "_a")


def drop_reason(verdict: Column, mismatch: Column, error: Column) -> Column:
    """Why a verified fact goes, the first reason that applies; null for a fact that stays."""
    return (
        F.when(error.isNotNull() | verdict.isNull(), "parse_error")
        .when(F.coalesce(mismatch, F.lit(False)), "span_not_in_text")
        .when(verdict == "CONTRADICTED", "contradicted")
        .when(verdict == "NOT_STATED", "not_stated")
        .when(verdict != "SUPPORTED", "unknown_verdict")
    )


def classified_facts(facts: DataFrame, backend=RuleBackend) -> DataFrame:
    """Adds `category`: SINGLE_ENTITY, MULTI_ENTITY or AMBIGUOUS, the last also where the answer fails."""
    asked = ask_json(facts.withColumn("_p", prompt("Classify the fact by its entities.", fact=F.col("fact"))), "_p", "_a", backend)
    known = category(_field("_a", "category", "label"), ("SINGLE_ENTITY", "MULTI_ENTITY", "AMBIGUOUS"))
    return asked.withColumn("category", F.coalesce(known, F.lit("AMBIGUOUS"))).drop("_p", "_a")


# ---- triples --------------------------------------------------------------------------------------


def fixed_triples(triples: DataFrame, key: str = "triple_id", backend=RuleBackend) -> DataFrame:
    """(key, subject, relation, object, status, reason): valid triples as they are, invalid ones after one fix by the model.

    A fix is cleaned and checked again. What stays invalid is discarded as still invalid, incomplete or failed; missing
    parts of an answer keep the old part.
    """
    s, r, o = (F.col(c) for c in ("subject", "relation", "object"))
    ok = F.coalesce(valid_relation(s, r, o), F.lit(False))
    evidence = F.col("evidence") if "evidence" in triples.columns else F.lit(None).cast("string")
    ask = F.when(~ok, prompt("Fix the triple so that its relation repeats neither end.", subject=s, relation=r, object=o, evidence=F.coalesce(evidence, F.lit(""))))
    rows = ask_json(triples.select(key, "subject", "relation", "object", ok.alias("_ok"), ask.alias("_p")), "_p", "_a", backend)
    new = {
        "_s": clean_entity(F.coalesce(_field("_a", "subject"), s)),
        "_r": blank_to_null(clean_relation(F.coalesce(_field("_a", "relation"), r))),
        "_o": clean_entity(F.coalesce(_field("_a", "object"), o), None),
    }
    rows = rows.withColumns(new)
    whole = F.col("_s").isNotNull() & F.col("_r").isNotNull() & F.col("_o").isNotNull()
    good = whole & valid_relation(F.col("_s"), F.col("_r"), F.col("_o"))
    reason = F.when(F.col("_a").isNull(), "failed").when(~whole, "incomplete").when(~good, "still_invalid")
    fixed = ~F.col("_ok") & reason.isNull()
    pick = lambda new, old: F.when(fixed, F.col(new)).otherwise(F.col(old)).alias(old)
    status = F.when(F.col("_ok"), "valid").when(fixed, "fixed").otherwise("discarded")
    return rows.select(key, pick("_s", "subject"), pick("_r", "relation"), pick("_o", "object"), status.alias("status"), F.when(~F.col("_ok"), reason).alias("reason"))


def rewritten(rows: DataFrame, backend=RuleBackend) -> DataFrame:
    """Relations of resolved triples whose object had text after its entity (method rewrite), from a sentence that ends in the entity.

    `rows` come from `resolved` with parts, materialised; other rows stay as they are. The relation is what stands between subject and entity in the rewritten
    sentence; without one the texts around the entity stay appended to the relation.
    """
    todo = rows.where("method = 'rewrite'")
    asked = cut(complete(todo.withColumn("_p", prompt("Rewrite so that the entity comes last.", subject=F.col("subject"), relation=F.col("stated"), object=F.col("whole"), entity=F.col("object"))), "_p", "_a", backend))
    said = F.when(F.contains(F.lower("_a"), F.lower("object")), inner_relation(F.col("_a"), F.col("subject"), F.col("object")))
    return rows.where("method <> 'rewrite'").unionByName(asked.withColumn("relation", F.coalesce(said, F.col("relation"))).select(*rows.columns))


def matched_relations(found: DataFrame, entities: DataFrame, backend=RuleBackend) -> DataFrame:
    """(doc_id, subject, relation, object, fixed) whose ends are both entities of their document, exactly.

    `found` has (doc_id, subject, relation, object), `entities` (doc_id, name). Relations with another end are sent back
    once with the entities that share a word with it, and stay only if both ends match then. The names of a document go
    to its relations once, or once for each part of many relations; lists of a relation are neither stored nor shuffled.
    Documents without names are not asked about, as nothing could match.
    """
    key = ["doc_id", "subject", "relation", "object"]
    names = cut(entities.select("doc_id", "name").where("doc_id is not null and name is not null").distinct())
    rows = cut(found.select(*key).join(names.select("doc_id").distinct(), "doc_id", "left_semi").distinct())
    first = cut(_ends_asked(rows, names, backend).withColumn("good", F.coalesce(parses(F.col("answer")), F.lit(False))))
    answers = first.where("good")
    bad = first.where("not known and not good")
    if not bad.isEmpty():
        again = F.when(F.coalesce(squeeze(F.col("answer")), F.lit("")) != "", F.concat(F.lit("Repair the JSON.\n\n"), "answer"))
        repaired = complete(bad.withColumn("_again", again), "_again", "_r", backend).drop("answer").withColumnRenamed("_r", "answer")
        repaired = cut(repaired.withColumn("good", F.coalesce(parses(F.col("answer")), F.lit(False))))
        strict = _ends_asked(repaired.where("not good").select(*key), names, backend, STRICT)
        strict = strict.where(F.coalesce(parses(F.col("answer")), F.lit(False)))
        answers = answers.select("doc_id", "answer").unionByName(repaired.where("good").select("doc_id", "answer")).unionByName(strict.select("doc_id", "answer"))
    fixed = answers.select("doc_id", _field("answer", "subject").alias("subject"), _field("answer", "relation", "predicate").alias("relation"), _field("answer", "object").alias("object"))
    fixed = fixed.where("relation is not null").distinct()
    for c in ("subject", "object"):
        fixed = fixed.join(names.withColumnRenamed("name", c), ["doc_id", c], "left_semi")
    return first.where("known").select(*key, F.lit(False).alias("fixed")).unionByName(fixed.select(*key, F.lit(True).alias("fixed")))


def _ends_asked(rows: DataFrame, names: DataFrame, backend, suffix: str = "") -> DataFrame:
    """Relations (doc_id, subject, relation, object) beside the names of their document, asked; those of a document with over PART are dealt to several tasks."""
    parts = rows.groupBy("doc_id").count().where(F.col("count") > PART).select("doc_id", F.ceil(F.sqrt(F.col("count") / PART)).cast("int").alias("parts"))
    own = F.coalesce("parts", F.lit(1))
    dealt = rows.join(F.broadcast(parts), "doc_id", "left").select("doc_id", F.pmod(F.xxhash64("subject", "relation", "object"), own).cast("int").alias("part"), F.lit(1).alias("kind"), "subject", "relation", "object")
    none = F.lit(None).cast("string")
    beside = names.join(F.broadcast(parts), "doc_id", "left").select("doc_id", F.explode(F.sequence(F.lit(0), own - 1)).alias("part"), F.lit(0).alias("kind"), F.col("name").alias("subject"), none.alias("relation"), none.alias("object"))
    both = dealt.unionByName(beside).repartition(partitions(rows.sparkSession), "doc_id", "part").sortWithinPartitions("doc_id", "part", "kind")
    return ends_asked(both, backend, suffix)


def same_entity(pairs: DataFrame, a: str = "x", b: str = "y", backend=RuleBackend) -> DataFrame:
    """Adds `same` to pairs of names or descriptions; an answer that is no yes counts as no."""
    from ..functions.answers import binary_verdict

    asked = complete(pairs.withColumn("_p", prompt("Do both name the same entity?", a=F.col(a), b=F.col(b))), "_p", "_a", backend)
    return asked.withColumn("same", F.coalesce(binary_verdict(F.col("_a")), F.lit(0)) == 1).drop("_p", "_a")


def entity_graphs(entities: DataFrame, docs: DataFrame, k: int = 5, backend=RuleBackend, embedder=HashedEmbedder) -> DataFrame:
    """(doc_id, subject, relation, object) of one small graph for each entity of `entities` (doc_id, name).

    The model sees the k sentences of the document nearest to the name and those that hold it, in order; entities whose
    answer fails give no row.
    """
    from ..functions.records import kg_triples

    sents = docs.select("doc_id", F.posexplode(rule_sentences(F.col("text"))).alias("pos", "s"))
    asked = entities.select("doc_id", "name").where("name is not null").distinct()
    sents = embedded(sents.join(asked.select("doc_id").distinct(), "doc_id", "left_semi"), "s", "sv", embedder)
    both = cut(embedded(asked, "name", "nv", embedder).join(sents, "doc_id").select("doc_id", "name", "pos", "s", dot(F.col("nv"), F.col("sv")).alias("sim")))
    w = Window.partitionBy("doc_id", "name").orderBy(F.desc("sim"), "pos")
    kept = both.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) | F.contains(F.lower("s"), F.lower("name")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), " ")
    ctx = kept.groupBy("doc_id", "name").agg(text.alias("ctx"))
    got = ask_json(ctx.withColumn("_p", prompt("Draw the graph of the entity.", entity=F.col("name"), text=F.col("ctx"))), "_p", "_a", backend)
    return kg_triples(got.select("doc_id", json_body(F.col("_a")).alias("payload")), "payload", ["doc_id"])


def cluster_relations(members: DataFrame, evidence: DataFrame, batch: int = 10, chars: int = 1000, backend=RuleBackend) -> DataFrame:
    """(doc_id, cluster, subject, relation, object): relations between unlinked members of a cluster, `batch` members a request.

    `members` (doc_id, cluster, name) come from `linking.unlinked`, `evidence` has (doc_id, cluster, evidence), cut after
    `chars` characters. Requests of one member and clusters of one are left out; relations come in lower case with
    underscores; ends must be members of the request.
    """
    w = Window.partitionBy("doc_id", "cluster").orderBy("name")
    rows = members.select("doc_id", "cluster", "name").distinct().withColumn("b", F.floor((F.row_number().over(w) - 1) / batch))
    lists = rows.groupBy("doc_id", "cluster", "b").agg(F.array_sort(F.collect_list("name")).alias("names")).where(F.size("names") >= 2)
    lists = lists.join(evidence, ["doc_id", "cluster"], "left")
    told = F.coalesce(F.when(F.length("evidence") > chars, F.concat(F.substring("evidence", 1, chars), F.lit("..."))).otherwise(F.col("evidence")), F.lit(""))
    got = ask_json(lists.withColumn("_p", prompt("Relate the entities where the evidence does.", entities=F.col("names"), evidence=told)), "_p", "_a", backend)
    found = answer_triples(got, "_a", ["doc_id", "cluster", "names"])
    found = found.where(F.array_contains("names", F.col("subject")) & F.array_contains("names", F.col("object")))
    return found.select("doc_id", "cluster", "subject", F.regexp_replace(clean_relation(F.col("relation")), " ", "_").alias("relation"), "object").distinct()


# ---- batch jobs -----------------------------------------------------------------------------------


def run_batch(spark: SparkSession, requests: DataFrame, folder: str, backend=RuleBackend, most: int = 50_000) -> DataFrame:
    """(custom_id, success, content, error): writes the request lines, has them answered, and reads the answers back.

    `requests` has (custom_id, prompt). A job that stopped goes on where it was: requests whose answer is in the folder
    are not asked again.
    """
    write_requests(requests, f"{folder}/requests", most)
    asked = spark.read.schema("custom_id string, prompt string").json(f"{folder}/requests")
    from ..sources.files import exists

    if exists(spark, f"{folder}/answers"):
        done = spark.read.schema("custom_id string").json(f"{folder}/answers")
        asked = asked.join(done, "custom_id", "left_anti")
    got = complete(asked, "prompt", "content", backend)
    ok = F.col("content").isNotNull()
    got.select("custom_id", ok.alias("success"), "content", F.when(~ok, "no answer").alias("error")).write.mode("append").json(f"{folder}/answers")
    return spark.read.schema("custom_id string, success boolean, content string, error string").json(f"{folder}/answers")
