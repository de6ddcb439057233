"""Nested extraction from HTML pages: one Arrow pass per page, of which only the parts asked for are kept, relational from there (H1-H13 of the survey)."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.html_tree import INLINE, Node, blocks, decode, hidden, parse
from caseloom.sources.tables import c, spread, table

#: Parts of a page's record and their types.
PARTS = {
    "status": "string", "title": "string", "locale": "string", "warnings": "array<string>", "metas": "array<struct<name:string,content:string>>",
    "sections": "array<struct<ordinal:int,level:int,heading:string,n_blocks:int,n_chars:int>>", "fields": "array<struct<ordinal:int,label:string,value:string>>",
    "panes": "array<struct<group:int,ordinal:int,pane_id:string,tab_label:string,language:string,method:string,text:string>>",
    "badges": "array<struct<ordinal:int,kind:string,values:array<string>>>", "charges": "array<struct<section:string,owner:string,ordinal:int,provision:string,outcome:string,n:int>>",
    "persons": "array<struct<ordinal:int,name:string,age:int,section:string>>", "text": "string",
}
# Names that languages have on tabs.
LANGUAGE_NAMES = {"english": "en", "español": "es", "français": "fr", "русский": "ru", "العربية": "ar", "中文": "zh", "deutsch": "de", "português": "pt"}


def walk(root: Node) -> Iterator[Node]:
    """All elements that show, in order; no recursion, as trees may be deep."""
    stack = [root]
    while stack:
        x = stack.pop()
        yield x
        stack += [k for k in reversed(x.kids) if not isinstance(k, str) and (not hidden(k) or k.tag in ("head", "meta"))]


def descendants(root: Node, tags: set[str]) -> Iterator[Node]:
    """Elements of these tags within root, in order, root aside."""
    return (x for x in walk(root) if x is not root and x.tag in tags)


def closest(node: Node, tags: set[str]) -> Node | None:
    """The nearest element of these tags that node is in, itself included."""
    while node is not None and node.tag not in tags:
        node = node.up
    return node


def owned(root: Node, tags: set[str], owners: set[str]) -> Iterator[Node]:
    """Elements of these tags whose nearest owner is root: those of an owner within it are left out."""
    for x in descendants(root, tags):
        up = x.up
        while up is not None and up is not root and up.tag not in owners:
            up = up.up
        if up is root:
            yield x


def text_of(node: Node, lines: bool = False) -> str:
    """The text that an element shows, without scripts, styles and templates: in one line, or a line a block."""
    return ("\n" if lines else " ").join(t for t, _ in blocks(node))


def classes(node: Node) -> set[str]:
    return set(node.attrs().get("class", "").split()) if node.attr else set()


def language(pane_id: str | None, label: str | None, locale: str | None, first: bool, href: str | None = None) -> tuple[str | None, str]:
    """Language of a pane and where it is from: the tab's name, the end of the pane's id, the end of the tab's link, the page."""
    if label and label.strip().casefold() in LANGUAGE_NAMES:
        return LANGUAGE_NAMES[label.strip().casefold()], "tab_label"
    for name, method in ((pane_id, "pane_id"), (href, "href")):
        if name and (m := re.search(r"(?:^|[#_-])(ar|de|en|es|fr|pt|ru|zh)$", name.lower())):
            return m[1], method
    if locale:
        return locale.lower(), "page_first_pane" if first else "page"
    return None, "unknown"


_HEADING = re.compile("h[1-6]")
# What heads the charges of a page, in the languages of its labels.
CHARGE_HEADINGS = {"charges", "cargos", "anklage", "anklagepunkte", "chefs d’accusation", "acusações"}
_CHARGE = re.compile(r"(.+): ([a-z]+), ([0-9]+)")
_AGE = re.compile(r"\(([0-9]{1,2}) years\)")


def extract(page_id: int, body: bytes | None, parts: set[str] | None = None) -> dict:
    """One page as a nested record, of the parts asked for. A page that can't be read keeps a row with a status."""
    want = set(PARTS) if parts is None else parts
    out = {"page_id": page_id, "status": "EMPTY", "title": None, "locale": None, "text": None} | {k: [] for k, t in PARTS.items() if t.startswith("array")}
    if not body:
        return out
    try:
        text = decode(body)
        root, title = parse(text)
        out |= {"status": "FOUND", "title": title or None}
        script = re.search(r"pageLocale\s*=\s*'([A-Za-z-]+)'", text)
        nodes = list(walk(root))
        tag = next((x.attrs().get("lang") for x in nodes if x.tag == "html"), None)
        out["locale"] = (script[1] if script else tag) or None
        found = blocks(root) if want - {"title", "locale", "metas", "panes", "badges"} else []
        heads = [(i, int(b.tag[1])) for i, (_, n) in enumerate(found) if _HEADING.fullmatch((b := _block(n)).tag)]
        ends = [*(i for i, _ in heads[1:]), len(found)][: len(heads)]
        if "metas" in want:
            for x in nodes:
                if x.tag == "meta" and (a := x.attrs()).get("content") and (a.get("property") or a.get("name")):
                    out["metas"].append({"name": a.get("property") or a.get("name"), "content": a["content"]})
        if "sections" in want:
            for k, ((i, level), end) in enumerate(zip(heads, ends, strict=True)):
                out["sections"].append({"ordinal": k + 1, "level": level, "heading": found[i][0], "n_blocks": end - i - 1, "n_chars": sum(len(t) for t, _ in found[i + 1 : end])})
        if "fields" in want:
            out["fields"] = _fields(nodes, found)
        if want & {"panes", "status", "warnings"}:
            out["panes"], notes = _panes(nodes, out["locale"])
            out["warnings"] += notes
        if "badges" in want:
            out["badges"] = _badges(nodes)
        if want & {"charges", "persons"}:
            out["charges"], out["persons"] = _charges(found, heads, ends)
        if "text" in want:
            out["text"] = "\n".join(t for t, _ in found) or None
        if not heads and want & {"status", "warnings"}:
            out["warnings"].append("NO_HEADING")
        if sum(x["language"] == "en" for x in out["panes"]) > 1:
            out["warnings"].append("SEVERAL_ENGLISH_PANES")
        if out["warnings"]:
            out["status"] = "PARTIAL"
    except Exception as e:  # noqa: BLE001 - a page never fails the job
        out |= {"status": "PARSE_ERROR", "warnings": [f"{type(e).__name__}: {e}"[:200]]}
    return out


def _block(node: Node) -> Node:
    while node.tag in INLINE and node.up is not None:
        node = node.up
    return node


def _fields(nodes: list[Node], found: list[tuple[str, Node]]) -> list[dict]:
    """Labelled values: dt/dd and th/td pairs, and short 'label: value' paragraphs."""
    out: list[dict] = []
    label = None
    for x in nodes:
        if x.tag in ("dt", "th"):
            label = text_of(x)
        elif x.tag in ("dd", "td") and label:
            out.append({"label": label, "value": text_of(x)})
            label = None
    if not out:
        for text, node in found:
            if _block(node).tag == "p" and (m := re.fullmatch(r"([^:.]{2,30}): (.{1,80})", text)):
                out.append({"label": m[1], "value": m[2]})
    return [{"ordinal": i + 1, **f} for i, f in enumerate(out)]


def _panes(nodes: list[Node], locale: str | None) -> tuple[list[dict], list[str]]:
    """Panes paired with the tabs of the list before them by position, repeated ids kept, and what is odd about them."""
    out: list[dict] = []
    notes: set[str] = set()
    labels: list[str] = []
    links: list[str | None] = []
    group = 0
    for x in nodes:
        names = classes(x)
        if "nav-tabs" in names:
            tabs = [k for k in x.kids if not isinstance(k, str)]
            labels = [text_of(k) for k in tabs]
            links = [next((a.attrs().get("href") for a in walk(k) if a.tag == "a"), None) for k in tabs]
        elif "tab-content" in names:
            group += 1
            panes = [k for k in x.kids if not isinstance(k, str) and "tab-pane" in classes(k)]
            ids = [k.attrs().get("id") for k in panes]
            if len(panes) != len(labels):
                notes.add("PANE_COUNT_MISMATCH")
            if len(set(ids)) < len(ids):
                notes.add("REPEATED_PANE_ID")
            for i, k in enumerate(panes):
                label = labels[i] if i < len(labels) else None
                lang, method = language(ids[i], label, locale, i == 0, links[i] if i < len(links) else None)
                if lang is None:
                    notes.add("UNKNOWN_PANE_LANGUAGE")
                out.append({"group": group, "ordinal": i + 1, "pane_id": ids[i], "tab_label": label, "language": lang, "method": method, "text": text_of(k)})
            labels, links = [], []
    return out, sorted(notes)


def _badges(nodes: list[Node]) -> list[dict]:
    """Boxes beside the text: a heading and the values of the container or list that follows it, up to the next heading of a container."""
    out: list[dict] = []
    for x in nodes:
        if x.tag != "aside":
            continue
        kind, values = None, []
        for text, node in [*blocks(x), ("", None)]:
            if node is None or _block(node).tag == "h3":
                if kind is not None:
                    out.append({"ordinal": len(out) + 1, "kind": kind, "values": values})
                kind, values = text, []
            else:
                values.append(text)
    return out


def _charges(found: list[tuple[str, Node]], heads: list[tuple[int, int]], ends: list[int]) -> tuple[list[dict], list[dict]]:
    """(charges, persons). A charge belongs to the person named last in its section; one before any person has no owner and is kept."""
    charges, persons = [], []
    for (i, _), end in zip(heads, ends, strict=True):
        section, owner = found[i][0], None
        for text, node in found[i + 1 : end]:
            m = _CHARGE.fullmatch(text) if _block(node).tag == "li" else None
            if m:
                charges.append({"section": section, "owner": owner, "ordinal": len(charges) + 1, "provision": m[1], "outcome": m[2], "n": int(m[3])})
                continue
            for p in _AGE.finditer(text):
                name: list[str] = []
                for word in reversed(text[: p.start()].split()):
                    if not word[0].isupper():
                        break
                    name.insert(0, word)
                owner = " ".join(name) or owner
                persons.append({"ordinal": len(persons) + 1, "name": " ".join(name) or None, "age": int(p[1]), "section": section})
    return charges, persons


def parsed_pages(df: DataFrame, parts: Sequence[str], id_col: str = "page_id", body_col: str = "body") -> DataFrame:
    """One nested record per page with the parts asked for; every page keeps its row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = ", ".join(["page_id long", *(f"{k} {PARTS[k]}" for k in parts)])
    schema, want = to_arrow_schema(StructType.fromDDL(ddl)), set(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 100) for i in range(0, batch.num_rows, 100)):
                rows = [extract(i, b, want) for i, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema=schema)

    return spread(df.select(c(id_col).cast("long").alias("page_id"), c(body_col).alias("body"))).mapInArrow(run, ddl)


def _pages(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    return parsed_pages(table(spark, sf_dir, "http_outcome"), parts)


def h01_parse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by parse status and warnings."""
    return _pages(spark, sf_dir, "status", "warnings").groupBy("status", F.array_join("warnings", "|").alias("warnings")).agg(F.count(F.lit(1)).alias("n_pages"))


def h02_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, locale and the text that a page shows, a line a block, without scripts, styles and templates."""
    return _pages(spark, sf_dir, "title", "locale", "text")


def h03_owned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of pages by the tag that they are in, the items that are their own (those of lists within them left out), and all items within them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = {"ul", "ol"}
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                rows = []
                for body in part.column(0).to_pylist():
                    for x in descendants(parse(decode(body))[0], lists) if body else ():
                        at = closest(x.up, {"nav", "aside", "footer", "header", "article", "main", "section", "div", "body", "#root"})
                        rows.append((at.tag if at else None, sum(1 for _ in owned(x, {"li"}, lists)), sum(1 for _ in descendants(x, {"li"}))))
                cols = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["inside", "own", "every"])

    rows = spread(table(spark, sf_dir, "http_outcome").select("body")).mapInArrow(run, "inside string, own long, every long")
    return rows.groupBy("inside").agg(F.count(F.lit(1)).alias("n_lists"), F.sum("own").alias("n_own_items"), F.sum("every").alias("n_items"))


def h04_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled fields of pages in order."""
    return _pages(spark, sf_dir, "fields").select("page_id", F.inline("fields"))


def h05_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panes of tab groups with their language."""
    return _pages(spark, sf_dir, "panes").select("page_id", F.inline("panes")).withColumn("n_chars", F.length("text")).drop("text")


def h06_english_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First English variant of each page that shows a case: of its panes, or its text where it has none; PARTIAL where nothing is English, with a note where several are."""
    english = F.filter("panes", lambda v: (v["language"] == "en") & (F.coalesce(v["text"], F.lit("")) != ""))
    p = _pages(spark, sf_dir, "panes", "sections", "locale").where(F.size("sections") > 0)
    status = F.when(F.size(english) > 0, "FOUND").when((F.size("panes") == 0) & (F.col("locale") == "en"), "WHOLE_PAGE").otherwise("PARTIAL")
    return p.select("page_id", F.get(english, 0)["text"].alias("english_text"), F.size("panes").alias("n_panes"), status.alias("status"), F.when(F.size(english) > 1, F.lit("SEVERAL_ENGLISH")).alias("note"))


def h07_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes beside the text of pages: their kinds and values in order; several of one kind on a page are joined and PARTIAL."""
    rows = _pages(spark, sf_dir, "badges").select("page_id", F.inline("badges"))
    got = rows.groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n_boxes"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "values"))), lambda x: x["values"])).alias("v"))
    return got.select("page_id", "kind", "n_boxes", F.size("v").alias("n_values"), F.array_join("v", " | ").alias("joined"), F.when(F.col("n_boxes") > 1, "PARTIAL").otherwise("FOUND").alias("status"))


def h09_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons that pages name with an age, in order, with their section."""
    return _pages(spark, sf_dir, "persons").select("page_id", F.inline("persons"))


def h10_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charges listed on pages, a row each: section, owner (null for an orphan), provision, outcome and the number that follows."""
    return _pages(spark, sf_dir, "charges").select("page_id", F.inline("charges"))


def h08_field_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field labels of all languages joined to one name each, and how often they occur."""
    names = {"court": "Court|Gericht|Juridiction|Tribunal", "date": "Decision date|Datum|Date|Fecha", "number": "File number|Aktenzeichen|Numéro|Número", "defendants": "Defendants|Angeklagte|Prévenus|Acusados"}
    name = F.lit("other")
    for k, labels in names.items():
        name = F.when(F.col("label").isin(*labels.split("|")), F.lit(k)).otherwise(name)
    return h04_fields(spark, sf_dir).groupBy(name.alias("field"), "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))


def h11_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of pages in order: heading, blocks, characters."""
    return _pages(spark, sf_dir, "sections").select("page_id", F.inline("sections"))


def h12_page_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole-page pass over all fetches: every page keeps one row, also one that is empty or can't be read; sections and panes are numbered without gaps."""
    p = _pages(spark, sf_dir, "status", "warnings", "sections", "panes", "fields", "charges")
    gaps = lambda x: F.exists(F.transform(x, lambda s, i: s["ordinal"] != i + 1), lambda b: b)
    return p.agg(
        F.count(F.lit(1)).alias("n_pages"), F.countDistinct("page_id").alias("n_ids"), F.count_if(F.col("status") == "EMPTY").alias("n_empty"), F.count_if(F.col("status") == "PARSE_ERROR").alias("n_errors"),
        F.count_if(gaps("sections") | gaps("fields") | gaps("charges")).alias("n_gapped"), F.count_if((F.col("status") == "EMPTY") & (F.size("sections") > 0)).alias("n_invented"),
    )


def h04_recorded_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that pages have, by the recorded document title: recorded ones that the page's differ from (blanks and entities aside)."""
    v = table(spark, sf_dir, "page_validation").where("document_title IS NOT NULL").select("page_id", F.trim(F.regexp_replace("document_title", r"\s+", " ")).alias("recorded"))
    html = table(spark, sf_dir, "http_outcome").where(F.col("body").cast("string").contains("<title>")).select("page_id")  # recorded titles of other files aren't in them
    got = v.join(html, "page_id", "left_semi").join(_pages(spark, sf_dir, "title"), "page_id")
    return got.agg(F.count(F.lit(1)).alias("n_titles"), F.count_if(F.coalesce("title", F.lit("")) != F.col("recorded")).alias("n_different"))


def _counted(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    return _pages(spark, sf_dir, part).select("page_id", F.size(part).cast("long").alias("n")).where("n > 0")


def h02_locales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The locale of every page."""
    return _pages(spark, sf_dir, "locale")


def h05_pane_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panes of each page that has some."""
    return _counted(spark, sf_dir, "panes")


def h09_person_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons with an age on each page that names some."""
    return _counted(spark, sf_dir, "persons")


def h10_charge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charges on each page that lists some."""
    return _counted(spark, sf_dir, "charges")


def h11_section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of each page that has some."""
    return _counted(spark, sf_dir, "sections")


def f26_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page's own URL from its meta tags against the recorded one."""
    og = F.get(F.filter("metas", lambda m: m["name"] == "og:url"), 0)["content"]
    v = table(spark, sf_dir, "page_validation").select("page_id", "og_url")
    return _pages(spark, sf_dir, "metas").select("page_id", og.alias("meta_url")).join(v, "page_id").select("page_id", F.col("meta_url").eqNullSafe(F.col("og_url")).alias("same"))


QUERIES = {
    f.__name__: f
    for f in (h01_parse_status, h02_page_texts, h03_owned_items, h04_fields, h04_recorded_titles, h05_panes, h06_english_variant, h07_badges, h08_field_categories, h09_persons, h10_charges, h11_sections, h12_page_accounts, h02_locales, h05_pane_counts, h09_person_counts, h10_charge_counts, h11_section_counts, f26_meta)
}
# Bodies as DuckDB prints them: quotes and line ends are escaped; tags that don't interrupt a text are taken out, and blanks collapsed.
_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(body::VARCHAR, '</?(?i:a|b|i|em|strong|span|font)( [^>]*)?>', '', 'g'), '\\x0A', ' ', 'g'), ' +', ' ', 'g')"
_COUNT = "SELECT page_id, n FROM (SELECT page_id, len(regexp_extract_all({}, '{}')) AS n FROM http_outcome) WHERE n > 0"
ORACLE = {
    "h02_locales": r"""SELECT page_id, coalesce(nullif(regexp_extract(body::VARCHAR, 'pageLocale\s*=\s*\\x27([A-Za-z-]+)\\x27', 1), ''), nullif(regexp_extract(body::VARCHAR, '<html[^>]* lang=\\x22([^\\]+)\\x22', 1), '')) AS locale FROM http_outcome""",
    "h05_pane_counts": _COUNT.format("body::VARCHAR", "tab-pane"),
    "h09_person_counts": _COUNT.format(_PLAIN, r"\([0-9]{1,2} years\)"),
    "h10_charge_counts": _COUNT.format(_PLAIN, "(?i)<li[^>]*>[^<]*?: [a-z]+, [0-9]+"),
    "h11_section_counts": _COUNT.format("body::VARCHAR", "(?i)<h[1-6][ >]"),
    "h04_recorded_titles": "SELECT count(*) AS n_titles, 0 AS n_different FROM page_validation WHERE document_title IS NOT NULL AND page_id IN (SELECT page_id FROM http_outcome WHERE contains(body::VARCHAR, '<title>'))",
    "f26_meta": r"""SELECT page_id, nullif(replace(regexp_extract(body::VARCHAR, 'og:url\\x22 content=\\x22([^\\]*)\\x22', 1), '&amp;', '&'), '') IS NOT DISTINCT FROM og_url AS same FROM http_outcome JOIN page_validation USING (page_id)""",
    "h12_page_accounts": "SELECT count(*) AS n_pages, count(DISTINCT page_id) AS n_ids, count(*) FILTER (coalesce(octet_length(body), 0) = 0) AS n_empty, 0 AS n_errors, 0 AS n_gapped, 0 AS n_invented FROM http_outcome",
}
