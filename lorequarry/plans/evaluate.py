"""Evaluation: match rates, proxies, ranking metrics, score summaries, the regression gate and the golden audit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph
from ..storage import materialize

# What the gate tolerates, by metric: direction that is worse, and by how much.
TOLERANCES = {
    "top1_source_match_rate": ("down", 0.05),
    "topk_source_match_rate": ("down", 0.05),
    "answer_keyword_recall_mean": ("down", 0.05),
    "idk_rate": ("up", 0.10),
}
#: Terms that one automaton holds, some 20 MB in a task; more terms take more automata.
VOCABULARY = 50_000
#: Automata that a task builds for one pass over the texts.
AUTOMATA = 4
#: Metrics of which less is better.
LESS_IS_BETTER = ("idk_rate", "avg_input_tokens", "avg_output_tokens")


def expected_ids(primary: Column, alternates: Column) -> Column:
    """The accepted source ids of a question as strings, the primary one first."""
    first = F.when(primary.isNotNull(), F.array(primary.cast("string"))).otherwise(F.array().cast("array<string>"))
    return F.concat(first, F.coalesce(F.transform(alternates, lambda a: a.cast("string")), F.array().cast("array<string>")))


def match_columns(expected: Column, retrieved: Column) -> dict[str, Column]:
    """Whether the first, and any, of the retrieved ids is accepted; without accepted ids neither is."""
    top1 = F.array_contains(expected, F.coalesce(F.try_element_at(retrieved, F.lit(1)), F.lit("")))
    return {"top1_source_match": F.coalesce(top1, F.lit(False)), "topk_source_match": F.coalesce(F.arrays_overlap(expected, retrieved), F.lit(False))}


def proxies(records: DataFrame) -> DataFrame:
    """One row of proxies over evaluation records; failed records count in the denominators."""
    recall = X.share_present(X.distinctive_terms(F.col("expected_answer")), F.array_join(F.coalesce("context_strings", F.array().cast("array<string>")), " "))
    mean = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return records.agg(
        F.count("*").alias("n"),
        mean(F.col("top1_source_match")).alias("top1_source_match_rate"),
        mean(F.col("topk_source_match")).alias("topk_source_match_rate"),
        F.avg(recall).alias("answer_keyword_recall_mean"),
        F.count(recall).alias("answer_keyword_recall_n"),
        mean(F.contains(F.coalesce("answer", F.lit("")), F.lit(X.IDK))).alias("idk_rate"),
        F.avg(F.coalesce("input_tokens", F.lit(0))).cast("long").alias("avg_input_tokens"),
        F.avg(F.coalesce("output_tokens", F.lit(0))).cast("long").alias("avg_output_tokens"),
    )


def as_metrics(one_row: DataFrame, names: list[str]) -> DataFrame:
    """(metric, value) rows of a row of metrics."""
    return one_row.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])).alias("metric", "value"))


def gate(current: DataFrame, baseline: DataFrame, tolerances: dict[str, tuple[str, float]] = TOLERANCES) -> DataFrame:
    """(metric, current, baseline, delta, verdict, failed) of metric rows (metric, value) against a baseline's.

    A metric that either side lacks fails.
    """
    spark = current.sparkSession
    rules = spark.createDataFrame([(m, d, t) for m, (d, t) in tolerances.items()], "metric string, direction string, tolerance double")
    both = F.broadcast(rules).join(current.select("metric", F.col("value").alias("current")), "metric", "left").join(baseline.select("metric", F.col("value").alias("baseline")), "metric", "left")
    delta = F.col("current") - F.col("baseline")
    worse = F.when(F.col("direction") == "down", delta < -F.col("tolerance")).otherwise(delta > F.col("tolerance"))
    return both.select("metric", "current", "baseline", delta.alias("delta"), verdict(F.col("metric"), delta).alias("verdict"), F.coalesce(worse, F.lit(True)).alias("failed"))


def verdict(metric: Column, delta: Column, dead_band: float = 0.001) -> Column:
    """better, same or worse."""
    good = F.when(metric.isin(*LESS_IS_BETTER), delta < 0).otherwise(delta > 0)
    return F.when(delta.isNull(), "missing").when(F.abs(delta) <= dead_band, "same").when(good, "better").otherwise("worse")


def check_regression(current: DataFrame, baseline: DataFrame) -> list[str]:
    """The failed metrics as messages; empty if the gate opens."""
    failed = gate(current, baseline).filter("failed").orderBy("metric").collect()  # as many rows as there are tolerances at most
    return [f"{r.metric}: {r.current} against {r.baseline} ({'missing' if r.delta is None else format(r.delta, '+.3f')})" for r in failed]


def same_queries(records: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides cut to the queries that both have."""
    return records.join(baseline.select("id").distinct(), "id", "left_semi"), baseline.join(records.select("id").distinct(), "id", "left_semi")


def score_summary(scores: DataFrame) -> DataFrame:
    """(metric, n, mean, pass_rate) of (id, scores map<string, struct<score, success>>); null scores are left out."""
    rows = scores.select(F.explode("scores").alias("metric", "s")).filter("s.score is not null")
    return rows.groupBy("metric").agg(F.count("*").alias("n"), F.avg("s.score").alias("mean"), F.avg(F.col("s.success").cast("int")).alias("pass_rate"))


def ranking_metrics(hits: DataFrame, relevant: Column, total: Column, k: int) -> DataFrame:
    """Recall, reciprocal rank and normalised gain at k for each query of ranked hits (query_id, rank)."""
    rows = hits.filter(F.col("rank") <= k).select("query_id", "rank", relevant.cast("int").alias("rel"), total.alias("total"))
    gain = F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.max("total"), F.lit(k))).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return rows.groupBy("query_id").agg(
        F.round(F.sum("rel") / F.nullif(F.max("total"), F.lit(0)), 6).alias("recall"),
        F.round(F.coalesce(F.max(F.when(F.col("rel") == 1, 1.0 / F.col("rank"))), F.lit(0.0)), 6).alias("rr"),
        F.round(gain / ideal, 6).alias("ndcg"),
    )


def worst(scores: DataFrame, metric: str, n: int) -> DataFrame:
    """The n worst rows by score of each group of a metric column."""
    return scores.withColumn("place", F.row_number().over(Window.partitionBy(metric).orderBy("score", "id"))).filter(F.col("place") <= n)


def audit(golden: DataFrame, documents: DataFrame) -> DataFrame:
    """Checks of golden questions (id, query, answer, expected_source_ids) against documents (source_id, content).

    missing_ids: accepted ids that no document has. subject_missing: query terms that the first
    accepted document lacks. answer_hit: share of the answer's terms in it. alternates: up to five
    other documents that hold almost all distinctive terms of the answer.
    """
    q = golden.select("id", "expected_source_ids", X.slice_terms(X.query_terms(F.col("query")), 8).alias("subject"), X.slice_terms(X.key_terms(F.col("answer")), 10).alias("terms"), X.key_terms(F.col("answer")).alias("all_terms"))
    q = q.withColumn("distinctive", X.slice_terms(F.filter("all_terms", X.is_distinctive), 5)).drop("all_terms")
    wanted = q.select("id", F.posexplode_outer("expected_source_ids").alias("at", "source_id"))
    missing = wanted.filter("source_id is not null").join(documents.select("source_id"), "source_id", "left_anti").groupBy("id").agg(F.array_sort(F.collect_list("source_id")).alias("missing_ids"))
    first = wanted.filter("at = 0").join(documents.select("source_id", "content"), "source_id").join(q.select("id", "subject", "terms"), "id")
    low = F.lower("content")
    lacking = F.filter("subject", lambda t: ~F.contains(low, F.lower(t)))
    answered = first.select("id", lacking.alias("subject_missing"), X.share_present(F.col("terms"), F.col("content")).alias("answer_hit"))
    alternates = other_sources(q, documents)
    return q.select("id", "expected_source_ids", "subject", "terms").join(missing, "id", "left").join(answered, "id", "left").join(alternates, "id", "left")


def terms_found(text: Column, parts: list[list[str]]) -> Column:
    """Those of the terms that stand in a text as substrings: the text meets an automaton of each part in turn."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            import ahocorasick
        except ImportError:
            # without the library each term is searched by itself, which takes a pass a term
            finders = [lambda t, part=part: {x for x in part if x in t} for part in parts]
        else:
            finders = []
            for part in parts:
                automaton = ahocorasick.Automaton()
                for x in part:
                    automaton.add_word(x, x)
                automaton.make_automaton()
                finders.append(lambda t, automaton=automaton: {x for _, x in automaton.iter(t)})
        for batch in batches:
            yield pa.array([sorted(set().union(*(find(t) for find in finders))) if (t := v.as_py()) else [] for v in batch], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)


def containment(texts: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """(key, term): the terms of vocabulary (term) that stand in each text as substrings, by any number of terms.

    Terms are dealt by hash to parts of about VOCABULARY, each of which goes to the tasks as one automaton; a pass
    over the texts takes AUTOMATA parts. So the work is texts times parts, and no text is joined with a term.
    Null and empty terms stand in no text.
    """
    terms = materialize(vocabulary.filter("term <> ''").select("term").distinct(), "vocabulary")
    n = max(1, -(-terms.count() // VOCABULARY))
    part = F.pmod(F.xxhash64("term"), F.lit(n))
    found = None
    for first in range(0, n, AUTOMATA):
        # the terms of a few parts, whatever the size of the vocabulary
        parts = [sorted(r.term for r in terms.filter(part == i).collect()) for i in range(first, min(n, first + AUTOMATA))]
        one = texts.select(key, F.explode(terms_found(F.col(text), parts)).alias("term"))
        found = one if found is None else found.unionByName(one)
    return found


def other_sources(questions: DataFrame, documents: DataFrame, n: int = 5) -> DataFrame:
    """(id, alternates): the n documents outside expected_source_ids with most distinctive terms, almost all at least.

    Questions and documents meet by the terms that `containment` finds.
    """
    terms = questions.select("id", "expected_source_ids", F.size("distinctive").alias("n"), F.explode("distinctive").alias("term"))
    vocabulary = terms.select(F.lower("term").alias("term")).distinct()
    texts = documents.select("source_id", F.lower("content").alias("low"))
    hits = containment(texts, "source_id", "low", vocabulary)
    counted = terms.withColumn("term", F.lower("term")).join(hits, "term").groupBy("id", "expected_source_ids", "n", "source_id").agg(F.count("*").alias("hits"))
    near = counted.filter((F.col("hits") >= F.greatest(F.lit(2), F.col("n") - 1)) & ~F.array_contains("expected_source_ids", F.col("source_id")))
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("hits"), "source_id"))).filter(F.col("place") <= n)
    return ranked.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "source_id"))), lambda s: s["source_id"]).alias("alternates"))


def composition(golden: DataFrame, minimums: dict[str, tuple[Column, int]]) -> DataFrame:
    """(kind, found, needed, enough) for each minimum that a golden set must meet."""
    counts = golden.agg(*[F.count_if(c).alias(name) for name, (c, _) in minimums.items()])
    rows = [F.struct(F.lit(name).alias("kind"), F.col(name).alias("found"), F.lit(need).cast("long").alias("needed"), (F.col(name) >= need).alias("enough")) for name, (_, need) in minimums.items()]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def agreement(judged: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Counts of judge and human verdicts (judge, human booleans), and whether they agree often enough."""
    c = judged.agg(F.count_if(F.expr("judge and human")).alias("both_pass"), F.count_if(F.expr("judge and not human")).alias("judge_only"), F.count_if(F.expr("not judge and human")).alias("human_only"), F.count_if(F.expr("not judge and not human")).alias("both_fail"))
    rate = (F.col("both_pass") + F.col("both_fail")) / F.nullif(F.col("both_pass") + F.col("judge_only") + F.col("human_only") + F.col("both_fail"), F.lit(0))
    return c.withColumn("agreement", rate).withColumn("enough", rate >= threshold)


def audit_counts(audited: DataFrame) -> DataFrame:
    """One row of counters over the rows of audit: questions, those without an accepted id, with missing ids, missing subject terms, alternates."""
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return audited.agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce(F.size("expected_source_ids"), F.lit(0)) <= 0).alias("no_source_id"),
        F.count_if(has("missing_ids")).alias("missing_source"),
        F.count_if(has("subject_missing")).alias("subject_missing"),
        F.count_if(has("alternates")).alias("has_alternates"),
    )


def source_f1(rows: DataFrame, expected: str, got: str) -> DataFrame:
    """rows with precision, recall and f1 of the distinct sources got against those expected; null where neither holds any."""
    want, have = (F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))) for c in (expected, got))
    hits, n = F.size(F.array_intersect(want, have)), F.size(want) + F.size(have)
    share = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    return rows.withColumns({"precision": share(hits, F.size(have)), "recall": share(hits, F.size(want)), "f1": share(2.0 * hits, n)})


def failure_clusters(scores: DataFrame, n_examples: int = 3) -> DataFrame:
    """(failed, n, examples): questions of (id, metric, success) that fail the same set of metrics, the largest group first in n."""
    failed = scores.filter("not success").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("metric")), ", ").alias("failed"))
    order = Window.partitionBy("failed").orderBy("id")
    ranked = failed.withColumn("place", F.row_number().over(order))
    return ranked.groupBy("failed").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("place") <= n_examples, F.col("id")))).alias("examples"))


def failure_groups(failed: DataFrame, k: int = 5, least: float = 0.8, n_examples: int = 3) -> DataFrame:
    """(first, n, reason, share, examples): failed questions (id, embedding, reason) grouped by what they ask.

    Questions hang together that are among each other's k nearest with a cosine of at least `least`; a group is named by its
    smallest id and has its commonest reason, the share of its questions with that, and its first examples. A question near no
    other is a group by itself; so are those without a direction.
    """
    once = failed.filter("id is not null").groupBy("id").agg(F.min_by("embedding", F.xxhash64("embedding")).alias("embedding"), F.min("reason").alias("reason"))
    once = materialize(once, "failed")
    named = graph.groups(graph.mutual_neighbours(once.select("id", "embedding"), k, least))
    rows = once.select("id", "reason").join(named, "id", "left").withColumn("first", F.coalesce("first", "id"))
    reasons = rows.groupBy("first", "reason").agg(F.count("*").alias("c"))
    common = reasons.groupBy("first").agg(F.sum("c").alias("n"), F.min(F.struct((-F.col("c")).alias("less"), "reason")).alias("top"))
    place = F.row_number().over(Window.partitionBy("first").orderBy("id"))
    examples = rows.withColumn("place", place).filter(F.col("place") <= n_examples).groupBy("first").agg(F.array_sort(F.collect_list("id")).alias("examples"))
    return common.join(examples, "first").select("first", "n", F.col("top.reason").alias("reason"), F.round(-F.col("top.less") / F.col("n"), 6).alias("share"), "examples")
