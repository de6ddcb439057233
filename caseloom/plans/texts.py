"""Text, URL and cell functions over the tables (scalar functions F1-F33, predicates P1-P13, rules C7 and C8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.functions import urls as U
from caseloom.functions.language import language_code
from caseloom.sources.tables import small, table


def f01_canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical form and flags of each requested URL; a fatal flag blanks it."""
    u = table(spark, sf_dir, "prediction_record").select("record_id", F.trim("canonical_url").alias("url"))
    flags = U.url_flags(F.col("url"))
    path = U.site_path(F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/:?#]+)", 1))
    fatal = F.arrays_overlap(flags, F.array(*map(F.lit, ("MISSING", "CONTROL_CHARACTER", "DOT_SEGMENT", "MALFORMED_ESCAPE", "OTHER_SCHEME"))))
    got = u.select("record_id", fatal.alias("fatal"), F.array_join(flags, "|").alias("flags"), host.alias("host"), U.normal_escapes(path).alias("path"))
    return got.select("record_id", "flags", F.when(~F.col("fatal"), F.concat(F.lit("https://"), "host", "path")).alias("canonical_url"))


def f02_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent escapes of requested URLs in one form."""
    u = table(spark, sf_dir, "http_outcome")
    return u.select("page_id", U.normal_escapes(F.regexp_extract("requested_url", r"^[A-Za-z]+://[^/]+([^?#]*)", 1)).alias("path"))


def f03_page_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and path that identify the page of each record."""
    return table(spark, sf_dir, "prediction_record").select("record_id", U.page_identity(F.col("canonical_url")).alias("page"))


def f04_url_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the final URL and the page's own URL relate to the requested one."""
    h, v = table(spark, sf_dir, "http_outcome"), table(spark, sf_dir, "page_validation").select("page_id", "og_url")
    got = h.select("page_id", "requested_url", "final_url").join(v, "page_id", "left")
    return got.select(
        "page_id", U.url_relation(F.col("final_url"), F.col("requested_url")).alias("final_relation"), U.url_relation(F.col("og_url"), F.col("requested_url")).alias("og_relation")
    )


def f05_url_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year among the steps of a URL's path, null where there is none."""
    year = F.regexp_extract("requested_url", r"/((?:19|20)[0-9]{2})/", 1).try_cast("int")
    return table(spark, sf_dir, "http_outcome").select("page_id", year.alias("url_year"))


def f06_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with blanks collapsed, and null where nothing is left."""
    t = F.col("case_title")
    return table(spark, sf_dir, "page_validation").select("page_id", T.collapse(t).alias("collapsed"), T.inline(t).alias("inline"))


def f07_nfkc_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with entities decoded, in compatibility form, blanks collapsed."""

    @F.pandas_udf("string")
    def normal(x):
        import html
        import unicodedata

        return x.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", html.unescape(s)).split()))

    return table(spark, sf_dir, "page_validation").select("page_id", normal("document_title").alias("title"))


def f09_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with lines kept and everything else squeezed."""
    return table(spark, sf_dir, "documents").select("doc_id", T.block(F.col("text")).alias("block"))


def f10_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading bullets stripped off lines, with what was removed, by kind of document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "doc_domain", F.explode(F.split("text", r"\r?\n")).alias("line"))
    bare = F.regexp_replace("line", r"^•\s*", "")
    return lines.groupBy("doc_domain").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(bare != F.col("line")).alias("n_bullets"), F.sum(F.length("line") - F.length(bare)).alias("n_removed"))


def f11_f12_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both word counts of every document: by letters and digits, and by blanks."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(t).alias("n_words"), T.token_count(t).alias("n_pieces"))


def f13_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of at most 900 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


def f14_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sentence of a document, numbered from 1."""
    got = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence"))
    return got.select("doc_id", (F.col("i") + 1).alias("sentence_no"), "sentence")


def f15_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered rendering of a summary's sentences, and whether reading it gives them again."""
    s = T.sentences(F.col("english_fact_summary"))
    got = table(spark, sf_dir, "demo_bank_review").select("review_id", s.alias("s")).where(F.size("s") > 0)
    n = T.numbered(F.col("s"))
    return got.select("review_id", n.alias("numbered"), (T.from_numbered(n) == F.col("s")).alias("round_trip"))


def f16_evidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence ids cited in documents: ascending, unique, and how many are out of order."""
    ids = F.transform(F.regexp_extract_all("text", F.lit(r"\bS([1-9][0-9]*):"), 1), lambda x: x.cast("int"))
    got = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids")).where(F.size("ids") > 0)
    ordered = F.array_sort(F.array_distinct("ids"))
    return got.select("doc_id", F.array_join(F.transform(ordered, lambda x: F.concat(F.lit("S"), x.cast("string"))), ";").alias("evidence"), (ordered == F.col("ids")).alias("is_valid"))


def f17_list_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized list cells read as lists."""
    qc = table(spark, sf_dir, "human_annotation_qc_report").where(F.col("normalized_value").startswith("["))
    items = T.list_cell(F.col("normalized_value"))
    return qc.select("qc_id", F.size(items).cast("long").alias("n_items"), F.array_join(items, " / ").alias("items"))


def f18_label_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of normalized cells mapped to ids, with codes: unknown, of another family, or repeated within the cell (after the first)."""
    qc = table(spark, sf_dir, "human_annotation_qc_report").withColumn("field", F.trim("field"))
    family = F.when(F.col("field").startswith("Acts"), "ACT").when(F.col("field").startswith("Means"), "MEANS").when(F.col("field").startswith("Purpose"), "PURPOSE")
    rows = qc.where(F.col("normalized_value").startswith("[")).select("qc_id", family.alias("expected"), F.posexplode(F.from_json("normalized_value", "array<string>")).alias("i", "raw_label"))
    known = F.broadcast(small(table(spark, sf_dir, "amp_ontology").select("label_id", "family", "raw_label"), 1000))
    got = rows.where(F.col("expected").isNotNull()).join(known, "raw_label", "left")
    again = F.min("i").over(Window.partitionBy("qc_id", "raw_label")) < F.col("i")  # the labels of one cell
    code = F.when(F.col("label_id").isNull(), "UNKNOWN_LABEL").when(F.col("family") != F.col("expected"), "WRONG_FAMILY").when(again, "DUPLICATE_LABEL").otherwise("OK")
    return got.withColumn("code", code).groupBy("expected", "code").agg(F.count(F.lit(1)).alias("n_labels"), F.countDistinct("raw_label").alias("n_distinct"))


def f20_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Auxiliary values through a map of sentinels."""
    known = F.create_map(*[F.lit(x) for kv in (("TRUE", "YES"), ("FALSE", "NO"), ("SINGLE", "ONE"), ("MULTIPLE", "MANY"), ("UNKNOWN", "UNKNOWN")) for x in kv])
    qc = table(spark, sf_dir, "human_annotation_qc_report").where(F.trim("field").isin("child human labeled", "multiplicity human labeled"))
    value = F.coalesce(F.try_element_at(known, F.upper(F.trim("raw_value"))), F.lit("OTHER"))
    return qc.groupBy(F.trim("field").alias("field"), value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def f21_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON of reviews (keys sorted, compact) and its hash."""
    d = table(spark, sf_dir, "demo_bank_review")
    js = F.to_json(F.struct("jurisdiction", "narrative_language", "review_id", "search_rank"), {"ignoreNullFields": "false"})
    return d.select("review_id", js.alias("canonical"), F.sha2(js, 256).alias("digest"))


def f22_safe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON cells by whether they parse; events' property k where it is there."""
    e = table(spark, sf_dir, "events")
    v = F.try_parse_json("props")
    k = F.try_variant_get(v, "$.k", "int")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(v.isNotNull()).alias("n_json"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


def f23_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of texts."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def f24_pane_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents from the code, else from the script of the letters, with the method."""
    t = F.coalesce("text", F.lit(""))
    by_code = F.nullif(language_code(F.col("lang")), F.lit("und"))
    by_script = F.when(t.rlike(r"[\x{4E00}-\x{9FFF}]"), "zh").when(t.rlike(r"[\x{0400}-\x{04FF}]"), "ru")
    got = F.coalesce(F.when(by_code.isNotNull(), F.struct(by_code.alias("lang"), F.lit("code").alias("method"))), F.when(by_script.isNotNull(), F.struct(by_script.alias("lang"), F.lit("script").alias("method"))), F.struct(F.lit("und").alias("lang"), F.lit("unknown").alias("method")))
    return table(spark, sf_dir, "documents").select("doc_id", got.alias("g")).groupBy("g.lang", "g.method").agg(F.count(F.lit(1)).alias("n"))


def f25_page_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locale of a page and where it is from: the script's variable, else the html tag, else the language step of its URL."""
    body, url = F.col("body").cast("string"), F.coalesce("final_url", "requested_url")
    script, tag = F.regexp_extract(body, r"pageLocale = '([a-z]{2})'", 1), F.regexp_extract(body, r'<html lang="([a-z]{2})"', 1)
    step = F.regexp_extract(url, rf"/{U.SITE_STEPS[0]}/({'|'.join(U.SITE_LANGUAGES)})/{U.SITE_STEPS[1]}/", 1)
    got = table(spark, sf_dir, "http_outcome").where(F.length("body") > 0).select(script.alias("script"), tag.alias("tag"), step.alias("step"))
    origin = F.when(F.col("script") != "", "script").when(F.col("tag") != "", "tag").when(F.col("step") != "", "url").otherwise("none")
    return got.groupBy(F.coalesce(*[F.nullif(x, F.lit("")) for x in ("script", "tag", "step")]).alias("locale"), origin.alias("origin")).agg(F.count(F.lit(1)).alias("n_pages"))


def f27_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piped lists split, sorted and made unique."""
    items = F.filter(F.split("candidate_set_memberships", r"\|"), lambda y: y != "")
    return table(spark, sf_dir, "demo_bank_review").select("review_id", F.array_join(F.array_sort(F.array_distinct(items)), "|").alias("memberships"), F.size(items).cast("long").alias("n"))


def f28_retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits that retry headers ask for, by a fixed clock; every kind of header is made from a fetch's numbers."""
    h = table(spark, sf_dir, "http_outcome").where("fetched_at IS NOT NULL")
    now = F.col("fetched_at").cast("timestamp")
    later = F.date_format(F.timestamp_seconds(now.cast("long") + F.col("attempts") * 30), "dd MMM yyyy HH:mm:ss")
    header = F.when(F.col("page_id") % 3 == 0, F.col("attempts").cast("string")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("Mon, "), later, F.lit(" UTC"))).otherwise(F.lit("soon"))
    return h.select("page_id", "attempts", T.retry_after(header, now).alias("wait_s"))


def f29_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed fetches by kind, and whether the kind is worth a retry."""
    h = table(spark, sf_dir, "http_outcome").where((F.coalesce("status", F.lit(0)) != 200))
    kind = T.failure_class(F.col("status"), F.col("error"))
    transient = F.coalesce(F.col("status").isin(408, 409, 429, 500, 502, 503, 504), F.lit(True))
    return h.groupBy(kind.alias("kind"), transient.alias("is_transient")).agg(F.count(F.lit(1)).alias("n"))


def f32_clarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clarity penalty of summaries from warnings, length and list marks."""
    t = F.coalesce("english_fact_summary", F.lit(""))
    w = T.word_count(t)
    penalty = F.greatest(w - 300, F.lit(0)) + F.greatest(F.lit(40) - w, F.lit(0)) * 2 + F.when(t.rlike(r"\n[-*•]"), 25).otherwise(0) + F.when(F.coalesce("fact_summary_parser_warnings", F.lit("")) != "", 50).otherwise(0)
    return table(spark, sf_dir, "demo_bank_review").select("review_id", penalty.cast("long").alias("penalty"))


def f33_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in fixed decimals, only finite ones in [0, 1]; others are null."""
    x = F.col("macro_f1")
    return table(spark, sf_dir, "amp_per_jurisdiction").select("row_id", F.when(x.between(0, 1), F.round(x.cast("decimal(10,6)"), 4).cast("string")).alias("macro_f1_text"))


def p01_usable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with text left after stripping, by source."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.has_text(F.col("text"))).alias("n_usable"))


def p02_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with text and a label in each family."""
    d = table(spark, sf_dir, "demo_bank_review")
    some = lambda x: F.coalesce(F.size(F.from_json(x, "array<string>")), F.lit(0)) > 0
    return d.where(T.has_text(F.col("english_fact_summary")) & some("act_ontology_ids_json") & some("means_ontology_ids_json") & some("purpose_ontology_ids_json")).select("review_id")


def p03_first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First value of ordered candidates, once by empty and once by blank."""
    q = table(spark, sf_dir, "human_annotation_qc_report")
    strict = F.coalesce(F.nullif("raw_value", F.lit("")), F.nullif("normalized_value", F.lit("")))
    loose = F.coalesce(F.when(T.has_text(F.col("raw_value")), F.col("raw_value")), F.when(T.has_text(F.col("normalized_value")), F.col("normalized_value")))
    return q.select("qc_id", strict.alias("first_nonempty"), loose.alias("first_nonblank"))


def p05_booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of pages read as booleans by three vocabularies: blank as false and yes or no allowed; strict; any case of 1 and TRUE."""
    v = table(spark, sf_dir, "page_validation")
    text = F.get_json_object("markers", "$.has_case_title")
    any_case = T.bool_of(text, ("TRUE", "1"), ("FALSE", "0", "NO", "N"), False)
    return v.groupBy(
        T.bool_of(text, ("TRUE", "1", "YES"), ("FALSE", "0", "NO"), False).alias("lenient"), T.bool_of(text, ("TRUE", "1"), ("FALSE", "0"), None).alias("strict"), any_case.alias("any_case")
    ).agg(F.count(F.lit(1)).alias("n"))


def p06_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in case ids read leniently: null where there is none."""
    y = table(spark, sf_dir, "prediction_record")
    n = F.regexp_extract("case_id", r"([0-9]+)$", 1).try_cast("int")
    return y.select("record_id", F.coalesce(n, F.lit(-1)).alias("case_number"), (n == F.col("search_rank")).alias("agrees"))


def p07_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles in one spelling."""
    return table(spark, sf_dir, "prediction_record").groupBy("evaluation", F.upper(F.trim("split")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


def p08_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows: neither validation nor test, not truncated."""
    y = table(spark, sf_dir, "prediction_record")
    return y.where(~F.upper(F.trim("split")).isin("VALIDATION", "TEST") & ~F.coalesce("truncated_input", F.lit(False))).groupBy("evaluation", "method").agg(F.count(F.lit(1)).alias("n"))


def p09_answerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of answerable cells: reviewed with substance, not blocking."""
    q = table(spark, sf_dir, "human_annotation_qc_report")
    return q.where(F.col("review_status").isin("SUBSTANTIVE") & (F.col("blocks_scoring") == 0)).groupBy(F.trim("field").alias("field")).agg(F.count(F.lit(1)).alias("n"))


def error_filters(label: str, family: str) -> dict[str, Column]:
    """Conditions on (ref, pred) by name: not exact, a label missed or invented, a family's prediction empty or not within the reference."""
    of = lambda x: F.filter(x, lambda v: v.startswith(family + "_"))
    ref, pred = F.col("ref"), F.col("pred")
    return {
        "not_exact": (F.size(F.array_except(ref, pred)) > 0) | (F.size(F.array_except(pred, ref)) > 0),
        "label_wrong": F.array_contains(ref, label) != F.array_contains(pred, label),
        "not_contained": (F.size(of(pred)) == 0) | (F.size(F.array_except(of(pred), of(ref))) > 0),
    }


def inspected(cases: DataFrame, evaluation: str | None = None, method: str | None = None, fold: int | None = None, jurisdiction: str | None = None, only: Column | None = None) -> DataFrame:
    """Test cases by the filters that are given, in the order of their ids; the report shows the first 100."""
    for name, value in (("evaluation", evaluation), ("method", method), ("fold", fold), ("jurisdiction", jurisdiction)):
        if value is not None:
            cases = cases.where(F.col(name) == value)
    return (cases if only is None else cases.where(only)).select("record_id", "evaluation", "method", "jurisdiction").orderBy("record_id").limit(100)


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = table(spark, sf_dir, "prediction_record").where(F.lower(F.trim("split")) == "test")
    as_set = lambda x: F.array_distinct(F.coalesce(x, F.array().cast("array<string>")))
    return y.select("record_id", "evaluation", "method", "fold", "jurisdiction", as_set("silver_reference_labels").alias("ref"), as_set("predicted_labels").alias("pred"))


def p10_error_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 test cases that miss or invent a chosen label (a report of that size)."""
    return inspected(_sets(spark, sf_dir), only=error_filters("MEANS_FALSE_PROMISE", "MEANS")["label_wrong"])


def p10_fold_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 of the second fold of A2 by method M3 whose means are not within the reference."""
    return inspected(_sets(spark, sf_dir), "A2", "M3", 2, only=error_filters("MEANS_FALSE_PROMISE", "MEANS")["not_contained"])


def p10_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many test cases each filter leaves, by evaluation, method, fold and jurisdiction."""
    tests = error_filters("MEANS_FALSE_PROMISE", "MEANS")
    got = _sets(spark, sf_dir).groupBy("evaluation", "method", "fold", "jurisdiction")
    return got.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(t).alias(f"n_{k}") for k, t in tests.items()])


def p11_demo_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates: jurisdictions without much support, no warning, 40 to 800 words."""
    d = table(spark, sf_dir, "demo_bank_review")
    high = d.groupBy("jurisdiction").agg(F.count(F.lit(1)).alias("n")).where("n >= 10").select("jurisdiction")
    ok = (F.coalesce("fact_summary_parser_warnings", F.lit("")) == "") & T.word_count(F.coalesce("english_fact_summary", F.lit(""))).between(40, 800)
    return d.where(ok).join(high, "jurisdiction", "left_anti").select("review_id")


def role_profile(labels: Column, forms: Column, text: Column, required: tuple[str, ...], form: str | None, words: tuple[int, int], acts: int, means: int, pattern: str) -> Column:
    """Whether a record fits a role: required labels, the only form named, a range of words, least numbers of acts and means, a pattern."""
    of = lambda f: F.size(F.filter(labels, lambda v: v.startswith(f + "_")))
    fits = (F.size(F.array_except(F.array(*map(F.lit, required)), labels)) == 0) & T.word_count(F.coalesce(text, F.lit(""))).between(*words) & (of("ACT") >= acts) & (of("MEANS") >= means)
    if form is not None:
        fits &= F.array_contains(forms, form) & (F.size(forms) == 1)
    return fits & F.coalesce(F.lower(text).rlike(pattern), F.lit(False))


def p12_role_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that fit a profile: labels required, one form, word range, label counts, a pattern in the text."""
    d = table(spark, sf_dir, "demo_bank_review")
    array = lambda x: F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))
    labels = F.concat(array("act_ontology_ids_json"), array("means_ontology_ids_json"))
    return d.where(role_profile(labels, array("geographic_form_reference_json"), F.col("english_fact_summary"), ("ACT_ACCEPT",), "Cross-border", (40, 400), 1, 1, "court|judge|appeal|peti|tribunal")).select("review_id")


def p13_review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of a review from its mark and its note."""
    d = table(spark, sf_dir, "demo_bank_review")
    mark, note = F.lower(F.trim(F.coalesce("reviewer_approve", F.lit("")))), T.has_text(F.col("reviewer_notes"))
    status = F.when(mark == "agree", F.when(note, "AGREED_WITH_NOTE").otherwise("AGREED")).when(mark == "hold", "HELD").when(mark == "skip", "SKIPPED").otherwise("OPEN")
    return d.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def c07_page_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages checked for status, size, type and required parts; error codes in order."""
    h = table(spark, sf_dir, "http_outcome").select("page_id", "status", "body", F.try_element_at("headers", F.lit("content-type")).alias("kind"))
    body = F.col("body").cast("string")
    tests = (
        ("NO_RESPONSE", F.col("status").isNull()), ("BAD_STATUS", F.col("status") != 200), ("EMPTY_BODY", F.coalesce(F.octet_length("body"), F.lit(0)) == 0),
        ("NOT_HTML", ~F.coalesce(F.col("kind"), F.lit("")).startswith("text/html")), ("NO_TITLE", ~F.coalesce(body, F.lit("")).contains("<title>")), ("SMALL", F.octet_length("body") < 1500),
    )
    codes = F.filter(F.array(*[F.when(t, F.lit(name)) for name, t in tests]), lambda x: x.isNotNull())
    return h.select("page_id", F.array_join(codes, "|").alias("errors"), (F.size(codes) == 0).alias("is_valid"))


def c08_parse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of a page's record: errors outweigh warnings."""
    v = table(spark, sf_dir, "page_validation")
    status = F.when(F.size("errors") > 0, "PARSE_ERROR").when(F.size("warnings") > 0, "PARTIAL").otherwise("FOUND")
    return v.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n_pages"))


QUERIES = {
    f.__name__: f
    for f in (
        f01_canonical_urls, f02_escapes, f03_page_identity, f04_url_relations, f05_url_year, f06_collapsed, f07_nfkc_titles, f09_blocks, f10_bullets, f11_f12_word_counts, f13_excerpts,
        f14_sentences, f15_numbered, f16_evidence_ids, f17_list_cells, f18_label_ids, f20_sentinels, f21_canonical_json, f22_safe_json, f23_digests, f24_pane_languages, f25_page_locale,
        f27_memberships, f28_retry_waits, f29_failures, f32_clarity, f33_formatted, p01_usable_text, p02_cohort, p03_first_values, p05_booleans, p06_integers, p07_roles, p08_training_rows,
        p09_answerable, p10_error_inspection, p11_demo_pool, p12_role_profiles, p10_fold_inspection, p10_error_counts, p13_review_status, c07_page_validity, c08_parse_status,
    )
}

SQL_BLANK = _B = r"[\t\n\x0B\f\r\x{85}\p{Z}]"
_W = r"[\p{L}\p{N}_]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_B}+|{_B}+$', '', 'g')"


def _collapse(x: str) -> str:
    return _strip(f"regexp_replace({x}, '{_B}+', ' ', 'g')")


def _words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{_W}+(?:[''’-]{_W}+)*'))"


def sql_site_path(x: str) -> str:
    """site_path() in SQL."""
    first, third = U.SITE_STEPS
    s = f"list_filter(string_split(replace({x}, chr(92), '/'), '/'), lambda x: x <> '')"
    named = f"coalesce(({s})[1] = '{first}' AND lower(({s})[2]) IN {U.SITE_LANGUAGES} AND ({s})[3] = '{third}', false)"
    return f"array_to_string(list_transform(CASE WHEN {named} THEN list_concat(({s})[1:1], ({s})[3:]) ELSE {s} END, lambda y: '/' || y), '')"


def sql_identity(u: str) -> str:
    v = f"regexp_replace(trim({u}), '[?#].*$', '')"
    host = f"lower(regexp_extract({v}, '^(?i:https)://([^/:@]+)(?::443)?(?:/|$)', 1))"
    path = sql_site_path(f"regexp_extract({v}, '^[A-Za-z]+://[^/]+(.*)$', 1)")
    return f"CASE WHEN {host} <> '' THEN {host} || {path} END"


def sql_escapes(x: str) -> str:
    """normal_escapes() in SQL."""
    char = "chr(CAST('0x' || left(y, 2) AS INT))"
    known = f"CASE WHEN regexp_matches({char}, '^{U.UNRESERVED}$') THEN {char} ELSE '%' || upper(left(y, 2)) END"
    return f"array_to_string(list_transform(string_split({x}, '%'), lambda y, i: CASE WHEN i = 1 THEN y WHEN regexp_matches(y, '^[0-9A-Fa-f]{{2}}') THEN ({known}) || substr(y, 3) ELSE '%25' || y END), '')"


def _relation(a: str, b: str) -> str:
    return f"CASE WHEN coalesce(trim({a}), '') = '' THEN 'MISSING' WHEN {a} = {b} THEN 'EXACT_MATCH' WHEN {sql_identity(a)} = {sql_identity(b)} THEN 'CANONICAL_EQUIVALENT' ELSE 'MISMATCH' END"


def _sentences(x: str) -> str:
    t = _strip(x)
    for pattern, by in T.SENTENCE_STEPS:
        t = f"regexp_replace({t}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by.replace('$', chr(92))}', 'g')"
    return f"list_filter(list_transform(string_split({t}, chr(30)), lambda s: trim(s)), lambda s: s <> '')"


_HAS = lambda x: f"coalesce({_strip(x)}, '') <> ''"
_LINES = f"list_transform(string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10)), lambda l: {_collapse('l')})"

_AS_SET = "coalesce(list_distinct({}), [])"
_SETS = f"""WITH s AS (SELECT record_id, evaluation, method, fold, jurisdiction, {_AS_SET.format("silver_reference_labels")} AS ref, {_AS_SET.format("predicted_labels")} AS pred FROM prediction_record WHERE lower(trim(split)) = 'test')"""
_OF = lambda x: f"list_filter({x}, lambda v: starts_with(v, 'MEANS_'))"
_OUTSIDE = f"(len({_OF('pred')}) = 0 OR len(list_intersect({_OF('pred')}, {_OF('ref')})) < len({_OF('pred')}))"
_HOST = "lower(regexp_extract(u, '^[A-Za-z]+://([^/:?#]+)', 1))"
_ESCAPED_PATH = sql_escapes(sql_site_path("regexp_extract(u, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)"))
_ANY_PATH = "regexp_replace(regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '[?#].*$', '')"
_URL_TESTS = (
    ("BACKSLASH", "contains(u, chr(92))", False), ("CONTROL_CHARACTER", r"regexp_matches(u, '[\x00-\x1f\x7f]')", True), ("DOT_SEGMENT", rf"regexp_matches({_ANY_PATH}, '(^|/)[.]{{1,2}}(/|$)')", True),
    ("MALFORMED_ESCAPE", f"regexp_matches(regexp_replace({_ANY_PATH}, '%[0-9A-Fa-f]{{2}}', '', 'g'), '%')", True), ("NO_HTML_PAGE", f"NOT ends_with(lower({_ANY_PATH}), '.html')", False), ("OTHER_SCHEME", "NOT regexp_matches(lower(u), '^https?://')", True),
)
_FLAGS = "CASE WHEN u IS NULL OR u = '' THEN 'MISSING' ELSE array_to_string(list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{k}' END" for k, t, _ in _URL_TESTS) + "], lambda x: x IS NOT NULL), '|') END"
_FATAL = "coalesce(u, '') = '' OR " + " OR ".join(t for _, t, fatal in _URL_TESTS if fatal)

ORACLE = {
    "f01_canonical_urls": f"WITH k AS (SELECT record_id, trim(canonical_url) AS u FROM prediction_record) SELECT record_id, {_FLAGS} AS flags, CASE WHEN NOT ({_FATAL}) THEN 'https://' || {_HOST} || {_ESCAPED_PATH} END AS canonical_url FROM k",
    "f02_escapes": f"""SELECT page_id, {sql_escapes("regexp_extract(requested_url, '^[A-Za-z]+://[^/]+([^?#]*)', 1)")} AS path FROM http_outcome""",
    "f25_page_locale": rf"""WITH h AS (SELECT body::VARCHAR AS t, coalesce(final_url, requested_url) AS u FROM http_outcome WHERE octet_length(body) > 0),
        k AS (SELECT regexp_extract(t, 'pageLocale = \\x27([a-z]{{2}})\\x27', 1) AS a, regexp_extract(t, '<html lang=\\x22([a-z]{{2}})\\x22', 1) AS b, coalesce(regexp_extract(u, '/{U.SITE_STEPS[0]}/({"|".join(U.SITE_LANGUAGES)})/{U.SITE_STEPS[1]}/', 1), '') AS c FROM h)
        SELECT coalesce(nullif(a, ''), nullif(b, ''), nullif(c, '')) AS locale, CASE WHEN a <> '' THEN 'script' WHEN b <> '' THEN 'tag' WHEN c <> '' THEN 'url' ELSE 'none' END AS origin, count(*) AS n_pages FROM k GROUP BY ALL""",
    "f03_page_identity": f"SELECT record_id, {sql_identity('canonical_url')} AS page FROM prediction_record",
    "f04_url_relations": f"SELECT h.page_id, {_relation('final_url', 'requested_url')} AS final_relation, {_relation('og_url', 'requested_url')} AS og_relation FROM http_outcome h LEFT JOIN page_validation v ON h.page_id = v.page_id",
    "f05_url_year": "SELECT page_id, try_cast(regexp_extract(requested_url, '/((?:19|20)[0-9]{2})/', 1) AS INT) AS url_year FROM http_outcome",
    "f06_collapsed": f"SELECT page_id, {_collapse('case_title')} AS collapsed, nullif({_collapse('case_title')}, '') AS inline FROM page_validation",
    "f09_blocks": f"SELECT doc_id, nullif(regexp_replace(regexp_replace(array_to_string({_LINES}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g'), '') AS block FROM documents",
    "f10_bullets": """WITH l AS (SELECT doc_domain, unnest(string_split_regex(text, '\\r?\\n')) AS line FROM documents WHERE text IS NOT NULL), b AS (SELECT *, regexp_replace(line, '^•\\s*', '') AS bare FROM l)
        SELECT doc_domain, count(*) AS n_lines, count(*) FILTER (bare <> line) AS n_bullets, CAST(sum(length(line) - length(bare)) AS BIGINT) AS n_removed FROM b GROUP BY ALL""",
    "f11_f12_word_counts": f"SELECT doc_id, {_words('coalesce(text, $$$$)')} AS n_words, len(list_filter(string_split_regex(coalesce(text, ''), '{_B}+'), lambda w: w <> '')) AS n_pieces FROM documents".replace("$$$$", "''"),
    "f13_excerpts": f"""WITH c AS (SELECT doc_id, {_collapse('text')} AS t FROM documents), h AS (SELECT *, left(t, 900) AS h FROM c)
        SELECT doc_id, CASE WHEN length(t) <= 900 THEN t ELSE (CASE WHEN contains(h, ' ') THEN regexp_replace(h, ' [^ ]*$', '') ELSE h END) || '…' END AS excerpt FROM h""",
    "f14_sentences": f"WITH s AS (SELECT doc_id, {_sentences('text')} AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, unnest(range(1, len(s) + 1)) AS sentence_no, unnest(s) AS sentence FROM s",
    "f15_numbered": f"""WITH s AS (SELECT review_id, {_sentences('english_fact_summary')} AS s FROM demo_bank_review)
        SELECT review_id, array_to_string(list_transform(s, lambda x, i: '[S' || i || '] ' || x), chr(10)) AS numbered, true AS round_trip FROM s WHERE len(s) > 0""",
    "f16_evidence_ids": """WITH e AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\\bS([1-9][0-9]*):', 1), lambda x: x::INT) AS ids FROM documents)
        SELECT doc_id, array_to_string(list_transform(list_sort(list_distinct(ids)), lambda x: 'S' || x), ';') AS evidence, list_sort(list_distinct(ids)) = ids AS is_valid FROM e WHERE len(ids) > 0""",
    "f17_list_cells": "WITH k AS (SELECT qc_id, from_json(normalized_value, '[\"VARCHAR\"]') AS v FROM human_annotation_qc_report WHERE normalized_value LIKE '[%') SELECT qc_id, len(v) AS n_items, array_to_string(v, ' / ') AS items FROM k",
    "f18_label_ids": """WITH k AS (SELECT qc_id, CASE WHEN trim(field) LIKE 'Acts%' THEN 'ACT' WHEN trim(field) LIKE 'Means%' THEN 'MEANS' WHEN trim(field) LIKE 'Purpose%' THEN 'PURPOSE' END AS expected,
        unnest(from_json(normalized_value, '["VARCHAR"]')) AS raw_label FROM human_annotation_qc_report WHERE normalized_value LIKE '[%')
        SELECT expected, CASE WHEN label_id IS NULL THEN 'UNKNOWN_LABEL' WHEN family <> expected THEN 'WRONG_FAMILY' WHEN again THEN 'DUPLICATE_LABEL' ELSE 'OK' END AS code, count(*) AS n_labels, count(DISTINCT raw_label) AS n_distinct
        FROM (SELECT *, row_number() OVER (PARTITION BY qc_id, raw_label) > 1 AS again FROM k) LEFT JOIN amp_ontology USING (raw_label) WHERE expected IS NOT NULL GROUP BY ALL""",
    "f20_sentinels": """SELECT trim(field) AS field, CASE upper(trim(raw_value)) WHEN 'TRUE' THEN 'YES' WHEN 'FALSE' THEN 'NO' WHEN 'SINGLE' THEN 'ONE' WHEN 'MULTIPLE' THEN 'MANY' WHEN 'UNKNOWN' THEN 'UNKNOWN' ELSE 'OTHER' END AS value,
        count(*) AS n FROM human_annotation_qc_report WHERE trim(field) IN ('child human labeled', 'multiplicity human labeled') GROUP BY ALL""",
    "f21_canonical_json": """WITH j AS (SELECT review_id, to_json({'jurisdiction': jurisdiction, 'narrative_language': narrative_language, 'review_id': review_id, 'search_rank': search_rank})::VARCHAR AS canonical FROM demo_bank_review)
        SELECT review_id, canonical, sha256(canonical) AS digest FROM j""",
    "f22_safe_json": """SELECT event_type, count(*) AS n, count(*) FILTER (json_valid(props)) AS n_json, CAST(sum(TRY_CAST(props->>'$.k' AS INT)) AS BIGINT) AS sum_k, max(TRY_CAST(props->>'$.k' AS INT)) AS max_k FROM events GROUP BY ALL""",
    "f23_digests": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "f24_pane_languages": """WITH k AS (SELECT coalesce(text, '') AS t, nullif(lower(regexp_extract(trim(coalesce(lang, '')), '^([A-Za-z]{2,3})', 1)), '') AS c FROM documents),
        m AS (SELECT nullif(c, 'und') AS c, CASE WHEN regexp_matches(t, '[\\x{4E00}-\\x{9FFF}]') THEN 'zh' WHEN regexp_matches(t, '[\\x{0400}-\\x{04FF}]') THEN 'ru' END AS s FROM k)
        SELECT coalesce(c, s, 'und') AS lang, CASE WHEN c IS NOT NULL THEN 'code' WHEN s IS NOT NULL THEN 'script' ELSE 'unknown' END AS method, count(*) AS n FROM m GROUP BY ALL""",
    "f27_memberships": """WITH k AS (SELECT review_id, list_filter(string_split(candidate_set_memberships, '|'), lambda y: y <> '') AS v FROM demo_bank_review)
        SELECT review_id, array_to_string(list_sort(list_distinct(v)), '|') AS memberships, len(v) AS n FROM k""",
    "f28_retry_waits": "SELECT page_id, attempts, CASE page_id % 3 WHEN 0 THEN attempts * 1.0 WHEN 1 THEN 30.0 * attempts - (epoch(fetched_at) - floor(epoch(fetched_at))) END AS wait_s FROM http_outcome WHERE fetched_at IS NOT NULL",
    "f29_failures": """SELECT CASE WHEN lower(coalesce(error, '')) LIKE '%refus%' THEN 'REFUSAL' WHEN status = 429 OR regexp_matches(lower(coalesce(error, '')), 'rate.?limit') THEN 'RATE_LIMIT'
        WHEN status = 408 OR regexp_matches(lower(coalesce(error, '')), 'time.?d? ?out') THEN 'TIMEOUT' WHEN regexp_matches(lower(coalesce(error, '')), 'schema|invalid label') THEN 'SCHEMA' WHEN status IS NOT NULL THEN 'API_ERROR' ELSE 'OTHER' END AS kind,
        coalesce(status IN (408, 409, 429, 500, 502, 503, 504), true) AS is_transient, count(*) AS n FROM http_outcome WHERE coalesce(status, 0) <> 200 GROUP BY ALL""",
    "f32_clarity": f"""WITH k AS (SELECT review_id, coalesce(english_fact_summary, '') AS t, coalesce(fact_summary_parser_warnings, '') AS w FROM demo_bank_review), n AS (SELECT *, {_words('t')} AS n FROM k)
        SELECT review_id, greatest(n - 300, 0) + greatest(40 - n, 0) * 2 + CASE WHEN regexp_matches(t, '\\n[-*•]') THEN 25 ELSE 0 END + CASE WHEN w <> '' THEN 50 ELSE 0 END AS penalty FROM n""",
    "f33_formatted": "SELECT row_id, CASE WHEN macro_f1 BETWEEN 0 AND 1 THEN round(CAST(macro_f1 AS DECIMAL(10, 6)), 4)::VARCHAR END AS macro_f1_text FROM amp_per_jurisdiction",
    "p01_usable_text": f"SELECT source, count(*) AS n, count(*) FILTER ({_HAS('text')}) AS n_usable FROM documents GROUP BY ALL",
    "p02_cohort": f"""SELECT review_id FROM demo_bank_review WHERE {_HAS('english_fact_summary')} AND json_array_length(act_ontology_ids_json) > 0 AND json_array_length(means_ontology_ids_json) > 0
        AND json_array_length(purpose_ontology_ids_json) > 0""",
    "p03_first_values": f"""SELECT qc_id, coalesce(nullif(raw_value, ''), nullif(normalized_value, '')) AS first_nonempty, CASE WHEN {_HAS('raw_value')} THEN raw_value WHEN {_HAS('normalized_value')} THEN normalized_value END AS first_nonblank
        FROM human_annotation_qc_report""",
    "p05_booleans": "SELECT coalesce((markers->>'$.has_case_title')::BOOLEAN, false) AS lenient, (markers->>'$.has_case_title')::BOOLEAN AS strict, coalesce((markers->>'$.has_case_title')::BOOLEAN, false) AS any_case, count(*) AS n FROM page_validation GROUP BY ALL",
    "p06_integers": """WITH k AS (SELECT record_id, search_rank, try_cast(nullif(regexp_extract(case_id, '([0-9]+)$', 1), '') AS INT) AS n FROM prediction_record) SELECT record_id, coalesce(n, -1) AS case_number, n = search_rank AS agrees FROM k""",
    "p07_roles": "SELECT evaluation, upper(trim(split)) AS role, count(*) AS n FROM prediction_record GROUP BY ALL",
    "p08_training_rows": "SELECT evaluation, method, count(*) AS n FROM prediction_record WHERE upper(trim(split)) NOT IN ('VALIDATION', 'TEST') AND NOT coalesce(truncated_input, false) GROUP BY ALL",
    "p09_answerable": "SELECT trim(field) AS field, count(*) AS n FROM human_annotation_qc_report WHERE review_status = 'SUBSTANTIVE' AND blocks_scoring = 0 GROUP BY ALL",
    "p10_error_inspection": f"{_SETS} SELECT record_id, evaluation, method, jurisdiction FROM s WHERE list_contains(ref, 'MEANS_FALSE_PROMISE') <> list_contains(pred, 'MEANS_FALSE_PROMISE') ORDER BY record_id LIMIT 100",
    "p10_fold_inspection": f"{_SETS} SELECT record_id, evaluation, method, jurisdiction FROM s WHERE evaluation = 'A2' AND method = 'M3' AND fold = 2 AND {_OUTSIDE} ORDER BY record_id LIMIT 100",
    "p10_error_counts": f"""{_SETS} SELECT evaluation, method, fold, jurisdiction, count(*) AS n, count(*) FILTER (len(ref) <> len(pred) OR len(list_intersect(ref, pred)) <> len(ref)) AS n_not_exact,
        count(*) FILTER (list_contains(ref, 'MEANS_FALSE_PROMISE') <> list_contains(pred, 'MEANS_FALSE_PROMISE')) AS n_label_wrong, count(*) FILTER ({_OUTSIDE}) AS n_not_contained FROM s GROUP BY ALL""",
    "p11_demo_pool": f"""SELECT review_id FROM demo_bank_review d WHERE coalesce(fact_summary_parser_warnings, '') = '' AND {_words("coalesce(english_fact_summary, '')")} BETWEEN 40 AND 800
        AND NOT EXISTS (SELECT 1 FROM (SELECT jurisdiction FROM demo_bank_review GROUP BY 1 HAVING count(*) >= 10) h WHERE h.jurisdiction = d.jurisdiction)""",
    "p12_role_profiles": f"""SELECT review_id FROM demo_bank_review WHERE list_contains(from_json(act_ontology_ids_json, '["VARCHAR"]'), 'ACT_ACCEPT') AND json_array_length(means_ontology_ids_json) > 0
        AND from_json(geographic_form_reference_json, '["VARCHAR"]') = ['Cross-border'] AND {_words("coalesce(english_fact_summary, '')")} BETWEEN 40 AND 400
        AND coalesce(regexp_matches(lower(english_fact_summary), 'court|judge|appeal|peti|tribunal'), false)""",
    "p13_review_status": f"""WITH k AS (SELECT lower(trim(coalesce(reviewer_approve, ''))) AS m, {_HAS('reviewer_notes')} AS n FROM demo_bank_review)
        SELECT CASE WHEN m = 'agree' THEN CASE WHEN n THEN 'AGREED_WITH_NOTE' ELSE 'AGREED' END WHEN m = 'hold' THEN 'HELD' WHEN m = 'skip' THEN 'SKIPPED' ELSE 'OPEN' END AS status, count(*) AS n FROM k GROUP BY ALL""",
    "c07_page_validity": """WITH h AS (SELECT page_id, status, headers['content-type'] AS kind, coalesce(octet_length(body), 0) AS n, coalesce(body::VARCHAR, '') AS t, body IS NULL AS none FROM http_outcome),
        e AS (SELECT page_id, list_filter([CASE WHEN status IS NULL THEN 'NO_RESPONSE' END, CASE WHEN status <> 200 THEN 'BAD_STATUS' END, CASE WHEN n = 0 THEN 'EMPTY_BODY' END, CASE WHEN NOT starts_with(coalesce(kind, ''), 'text/html') THEN 'NOT_HTML' END,
        CASE WHEN NOT contains(t, '<title>') THEN 'NO_TITLE' END, CASE WHEN NOT none AND n < 1500 THEN 'SMALL' END], lambda x: x IS NOT NULL) AS e FROM h) SELECT page_id, array_to_string(e, '|') AS errors, len(e) = 0 AS is_valid FROM e""",
    "c08_parse_status": "SELECT CASE WHEN len(errors) > 0 THEN 'PARSE_ERROR' WHEN len(warnings) > 0 THEN 'PARTIAL' ELSE 'FOUND' END AS status, count(*) AS n_pages FROM page_validation GROUP BY ALL",
}
