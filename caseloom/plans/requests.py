"""Requests to a labelling service: payloads, validation, retries, reuse, state (L1-L8 of the survey)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.plans.metrics import families
from caseloom.sources.tables import table

INSTRUCTION = "Name the acts, means and purposes that the summary supports."
DEMOS = 6


def payload(case_id: Column, text: Column, labels: Sequence[str], demos: Column | None = None) -> Column:
    """A request as JSON: its metadata with hashes of the instruction and of the label list, the messages, and a strict schema of the answer."""
    message = lambda role, x: F.struct(x.alias("content"), F.lit(role).alias("role"))
    first, last = F.array(message("developer", F.lit(INSTRUCTION))), F.array(message("user", text))
    digest = lambda x: F.sha2(F.lit(x), 256)
    metadata = F.struct(case_id.alias("case_id"), digest(INSTRUCTION).alias("instruction_sha256"), digest(";".join(labels)).alias("labels_sha256"))
    schema = F.struct(F.array(*map(F.lit, labels)).alias("enum"), F.lit(True).alias("strict"))
    return F.to_json(F.struct(metadata.alias("metadata"), (F.concat(first, demos, last) if demos is not None else F.concat(first, last)).alias("messages"), schema.alias("schema")))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "prediction_record").where((F.lower(F.trim("split")) == "test") & F.col("fact_summary").isNotNull())


def label_ids(spark: SparkSession, sf_dir: str) -> list[str]:
    return [x for f in families(spark, sf_dir).values() for x in f]


def l01_zero_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-shot requests of test summaries and their hashes."""
    js = payload(F.col("case_id"), F.col("fact_summary"), label_ids(spark, sf_dir))
    return targets(spark, sf_dir).select("record_id", F.sha2(js, 256).alias("request_sha256"), F.length(js).alias("n_chars"))


def checked_demos(rows: Sequence[dict], heldout: Sequence[str] = (), n: int = DEMOS) -> list[dict]:
    """The demonstrations in order, or an error: there have to be n, in the orders 1 to n, with ids, ranks and URLs of their own,
    a text each, and none of a held-out jurisdiction."""
    got = sorted(rows, key=lambda r: r["demo_order"])
    if len(got) != n:
        raise ValueError(f"a request needs exactly {n} demonstrations, there are {len(got)}")
    if [r["demo_order"] for r in got] != list(range(1, n + 1)):
        raise ValueError(f"demonstrations must have the orders 1 to {n}")
    for key in ("review_id", "search_rank", "canonical_url"):
        if len({r[key] for r in got}) != n:
            raise ValueError(f"demonstrations must differ in {key}")
    if any(not (r["text"] or "").strip() for r in got):
        raise ValueError("a demonstration has no text")
    if bad := sorted({r["jurisdiction"] for r in got} & set(heldout)):
        raise ValueError(f"a held-out jurisdiction is among the demonstrations: {bad}")
    return got


def demo_bank(spark: SparkSession, sf_dir: str) -> list[dict]:
    """The six first proposals with a text, one a rank, renumbered (their proposed orders have gaps and repeats) and checked."""
    d = table(spark, sf_dir, "demo_bank_review").where("proposed_demo_order IS NOT NULL AND english_fact_summary IS NOT NULL AND trim(english_fact_summary) <> ''")
    one = d.groupBy("search_rank").agg(F.min_by(F.struct("review_id", "proposed_demo_order", "canonical_url", "jurisdiction", "english_fact_summary", "act_ontology_ids_json"), F.struct("proposed_demo_order", "review_id")).alias("r"))
    rows = one.select("search_rank", "r.*").orderBy("proposed_demo_order", "review_id").limit(DEMOS).collect()
    return checked_demos([{"demo_order": i, "review_id": r["review_id"], "search_rank": r["search_rank"], "canonical_url": r["canonical_url"], "jurisdiction": r["jurisdiction"], "text": r["english_fact_summary"], "labels": r["act_ontology_ids_json"]} for i, r in enumerate(rows, 1)])


def l02_few_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few-shot requests: six checked demonstrations in order before each summary; a case that is one is left out."""
    demos = demo_bank(spark, sf_dir)
    turns = [F.struct(F.lit(x).alias("content"), F.lit(role).alias("role")) for r in demos for role, x in (("user", r["text"]), ("assistant", r["labels"]))]
    p = targets(spark, sf_dir).where(~F.coalesce(F.col("search_rank").isin(*[r["search_rank"] for r in demos]), F.lit(False)))
    js = payload(F.col("case_id"), F.col("fact_summary"), label_ids(spark, sf_dir), F.array(*turns))
    return p.select("record_id", F.sha2(js, 256).alias("request_sha256"), F.lit(len(demos)).alias("n_demos"))


def l03_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers checked against the label list, any order accepted, brought into the list's order."""
    ids = [x for f in families(spark, sf_dir).values() for x in f]
    known = F.array(*map(F.lit, ids))
    p = table(spark, sf_dir, "prediction_record")
    answer = F.from_json(F.to_json(F.struct(F.col("predicted_labels").alias("labels"))), "labels array<string>")["labels"]
    code = F.when(answer.isNull(), "MISSING").when(F.size(F.array_except(answer, known)) > 0, "UNKNOWN_LABEL").when(F.size(F.array_distinct(answer)) < F.size(answer), "REPEATED_LABEL").otherwise("VALID")
    return p.select("record_id", code.alias("code"), F.array_join(F.filter(known, lambda x: F.array_contains(answer, x)), ";").alias("labels"))


def l04_retry_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed attempts of each user folded in time, a run of errors being one request.

    The k-th attempt of a run waits for twice as long as the one before, for what the service asks for (value) if that is more, and for 60 at most.
    A run has five attempts; an incomplete answer (value over 18) ends them, and up to two attempts of the fallback follow; what comes later isn't sent.
    """
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("failed"), "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    runs = e.withColumn("run", F.sum((~F.col("failed")).cast("int")).over(w)).where("failed")
    w = Window.partitionBy("user_id", "run").orderBy("ts", "event_id")
    runs = runs.withColumn("k", F.row_number().over(w)).withColumn("after", F.sum((F.col("value") > 18).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("fallback", F.coalesce("after", F.lit(0)) > 0).withColumn("j", F.sum(F.col("fallback").cast("int")).over(w))
    kind = F.when(~F.col("fallback") & (F.col("k") <= 5), "PRIMARY").when(F.col("fallback") & (F.col("j") <= 2) & (F.col("k") - F.col("j") <= 5), "FALLBACK").otherwise("NOT_SENT")
    wait = F.least(F.lit(60.0), F.greatest(F.pow(F.lit(2.0), F.col("k") - 1), F.coalesce("value", F.lit(0.0))))
    got = runs.withColumn("kind", kind).groupBy("user_id")
    of = lambda k: F.count_if(F.col("kind") == k)
    return got.agg(of("PRIMARY").alias("n_primary"), of("FALLBACK").alias("n_fallback"), of("NOT_SENT").alias("n_not_sent"), F.max("k").cast("long").alias("longest_run"), F.sum(F.when(F.col("kind") != "NOT_SENT", wait)).alias("total_wait"))


def l07_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each method and rank, which earlier prediction answers the request of the last one: the first by path and row that is
    validated and asks for the same; every other record is rejected with its reasons. The last record itself isn't a candidate."""
    known = F.array(*map(F.lit, label_ids(spark, sf_dir)))
    answer = F.col("predicted_labels")
    valid = F.coalesce((F.size(F.array_except(answer, known)) == 0) & (F.size(F.array_distinct(answer)) == F.size(answer)), F.lit(False))
    p = table(spark, sf_dir, "prediction_record").select(
        "record_id", "method", "search_rank", F.sha2(F.concat_ws("|", "method", F.coalesce("fact_summary", F.lit(""))), 256).alias("request"),
        F.coalesce(F.size(answer) > 0, F.lit(False)).alias("present"), valid.alias("valid"), F.struct("source_path", "source_row", "record_id").alias("o"),
    )
    last = p.groupBy("method", "search_rank").agg(F.max("record_id").alias("last_id"), F.max_by("request", "record_id").alias("wanted"))
    rows = p.join(last, ["method", "search_rank"]).where(F.col("record_id") != F.col("last_id"))
    rows = rows.withColumn("fits", F.col("present") & F.col("valid") & (F.col("request") == F.col("wanted")))
    first = rows.where("fits").groupBy("method", "search_rank").agg(F.min("o").alias("first"))
    rows = rows.join(first, ["method", "search_rank"], "left")
    reasons = F.array(
        F.when(~F.col("present"), F.lit("NO_PREDICTION")), F.when(~F.col("valid"), F.lit("NOT_VALIDATED")), F.when(F.col("request") != F.col("wanted"), F.lit("OTHER_REQUEST")),
        F.when(F.col("fits") & (F.col("o") != F.col("first")), F.lit("NOT_FIRST")),
    )
    found = F.array_join(F.filter(reasons, lambda x: x.isNotNull()), "|")
    return rows.select("record_id", found.alias("reasons")).select("record_id", F.when(F.col("reasons") == "", "REUSED").otherwise("REJECTED").alias("outcome"), "reasons")


def l08_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each fetched rank: a success wins, else the last failure, else missing."""
    h = table(spark, sf_dir, "http_outcome")
    ok = (F.coalesce("status", F.lit(0)) == 200) & (F.octet_length("body") > 0)
    got = h.groupBy("search_rank").agg(F.max(F.when(ok, 1).otherwise(0)).alias("ok"), F.max_by(F.coalesce(F.col("status").cast("int"), F.lit(0)), F.struct("fetched_at", "page_id")).alias("last_status"))
    d = table(spark, sf_dir, "demo_bank_review").select("search_rank").distinct().join(got, "search_rank", "left")
    state = F.when(F.col("ok") == 1, "SUCCESS").when(F.col("ok") == 0, F.concat(F.lit("FAILED_"), F.col("last_status").cast("string"))).otherwise("MISSING")
    return d.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (l01_zero_shot, l02_few_shot, l03_validated, l04_retry_states, l07_reuse, l08_states)}
_MESSAGE = "{{'content': {}, 'role': '{}'}}"


def _payload(demos: str) -> str:
    """payload() in SQL; o is a row with the label list."""
    metadata = f"{{'case_id': case_id, 'instruction_sha256': sha256('{INSTRUCTION}'), 'labels_sha256': sha256(array_to_string(ids, ';'))}}"
    messages = f"list_concat([{_MESSAGE.format(chr(39) + INSTRUCTION + chr(39), 'developer')}], {demos}, [{_MESSAGE.format('fact_summary', 'user')}])"
    return f"to_json({{'metadata': {metadata}, 'messages': {messages}, 'schema': {{'enum': ids, 'strict': true}}}})::VARCHAR"


_TARGETS = "prediction_record CROSS JOIN (SELECT list(label_id ORDER BY label_ord) AS ids FROM amp_ontology) o WHERE lower(trim(split)) = 'test' AND fact_summary IS NOT NULL"
_RECORD = "CASE WHEN {} THEN '{}' END"
ORACLE = {
    "l01_zero_shot": f"WITH k AS (SELECT record_id, {_payload('[]')} AS js FROM {_TARGETS}) SELECT record_id, sha256(js) AS request_sha256, length(js) AS n_chars FROM k",
    "l02_few_shot": f"""WITH d1 AS (SELECT * FROM demo_bank_review WHERE proposed_demo_order IS NOT NULL AND trim(english_fact_summary) <> '' QUALIFY row_number() OVER (PARTITION BY search_rank ORDER BY proposed_demo_order, review_id) = 1),
        d AS (SELECT *, row_number() OVER (ORDER BY proposed_demo_order, review_id) AS k FROM d1 QUALIFY row_number() OVER (ORDER BY proposed_demo_order, review_id) <= {DEMOS}),
        t AS (SELECT flatten(list([{_MESSAGE.format('english_fact_summary', 'user')}, {_MESSAGE.format('act_ontology_ids_json', 'assistant')}] ORDER BY k)) AS turns, count(*) AS n FROM d)
        SELECT record_id, sha256({_payload('turns')}) AS request_sha256, n AS n_demos FROM t, {_TARGETS} AND search_rank NOT IN (SELECT search_rank FROM d)""",
    "l04_retry_states": """WITH e AS (SELECT user_id, ts, event_id, value, event_type = 'error' AS f, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
        k AS (SELECT *, row_number() OVER w AS k, coalesce(sum((value > 18)::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS fb FROM e WHERE f WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, event_id)),
        j AS (SELECT *, sum(fb::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS j FROM k), s AS (SELECT *, CASE WHEN NOT fb AND k <= 5 THEN 'PRIMARY' WHEN fb AND j <= 2 AND k - j <= 5 THEN 'FALLBACK' ELSE 'NOT_SENT' END AS kind FROM j)
        SELECT user_id, count(*) FILTER (kind = 'PRIMARY') AS n_primary, count(*) FILTER (kind = 'FALLBACK') AS n_fallback, count(*) FILTER (kind = 'NOT_SENT') AS n_not_sent, max(k) AS longest_run,
        sum(CASE WHEN kind <> 'NOT_SENT' THEN least(60.0, greatest(pow(2.0, k - 1), coalesce(value, 0.0))) END) AS total_wait FROM s GROUP BY ALL""",
    "l07_reuse": f"""WITH o AS (SELECT list(label_id) AS ids FROM amp_ontology), p AS (SELECT record_id, method, search_rank, sha256(method || '|' || coalesce(fact_summary, '')) AS request, source_path, source_row, coalesce(len(predicted_labels) > 0, false) AS present,
          coalesce(len(list_filter(predicted_labels, lambda x: NOT list_contains(ids, x))) = 0 AND len(list_distinct(predicted_labels)) = len(predicted_labels), false) AS valid FROM prediction_record CROSS JOIN o),
        l AS (SELECT *, max(record_id) OVER w AS last_id, arg_max(request, record_id) OVER w AS wanted FROM p WINDOW w AS (PARTITION BY method, search_rank)),
        r AS (SELECT *, present AND valid AND request = wanted AS fits FROM l WHERE record_id <> last_id AND search_rank IS NOT NULL AND method IS NOT NULL),
        n AS (SELECT *, row_number() OVER (PARTITION BY method, search_rank, fits ORDER BY source_path, source_row, record_id) AS k FROM r),
        s AS (SELECT record_id, array_to_string(list_filter([{_RECORD.format('NOT present', 'NO_PREDICTION')}, {_RECORD.format('NOT valid', 'NOT_VALIDATED')}, {_RECORD.format('request <> wanted', 'OTHER_REQUEST')}, {_RECORD.format('fits AND k > 1', 'NOT_FIRST')}], lambda x: x IS NOT NULL), '|') AS reasons FROM n)
        SELECT record_id, CASE WHEN reasons = '' THEN 'REUSED' ELSE 'REJECTED' END AS outcome, reasons FROM s""",
    "l03_validated": """WITH p AS (SELECT record_id, predicted_labels AS a FROM prediction_record), o AS (SELECT list(label_id ORDER BY label_ord) AS ids FROM amp_ontology)
        SELECT record_id, CASE WHEN a IS NULL THEN 'MISSING' WHEN len(list_filter(a, lambda x: NOT list_contains(ids, x))) > 0 THEN 'UNKNOWN_LABEL' WHEN len(list_distinct(a)) < len(a) THEN 'REPEATED_LABEL' ELSE 'VALID' END AS code,
        array_to_string(list_filter(ids, lambda x: list_contains(a, x)), ';') AS labels FROM p CROSS JOIN o""",
    "l08_states": """WITH g AS (SELECT search_rank, max(CASE WHEN coalesce(status, 0) = 200 AND octet_length(body) > 0 THEN 1 ELSE 0 END) AS ok, arg_max(coalesce(status::INT, 0), (fetched_at, page_id)) AS last_status FROM http_outcome GROUP BY ALL)
        SELECT CASE WHEN ok = 1 THEN 'SUCCESS' WHEN ok = 0 THEN 'FAILED_' || last_status ELSE 'MISSING' END AS state, count(*) AS n FROM (SELECT DISTINCT search_rank FROM demo_bank_review) LEFT JOIN g USING (search_rank) GROUP BY ALL""",
}
