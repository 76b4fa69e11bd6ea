"""Further registered queries: small operators over whole tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry.functions import fixed, text
from casequarry.operators import analysis, boxes, evaluate, groups, reports, rules, store
from casequarry.plans.queries import _NOTES_SQL, DOCS_SQL, documents
from casequarry.sources.tables import table

NOW = "2026-02-01T00:00:00"
STEP = "array<struct<timestamp:string,description_snapshot:string>>"


def q40_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and labels of parts: titles, file names, safe names, normal forms, short labels, roles."""
    parts = table(spark, sf_dir, "part")
    label = F.when(F.col("p_size") > 25, F.lit("Top")).otherwise(F.col("p_type"))
    return parts.select(
        "p_partkey",
        text.title(F.when(F.col("p_size") > 10, F.col("p_type")), F.col("p_name")).alias("title"),
        text.file_name(F.concat(F.lit("/a/b/"), "p_name")).alias("file_name"),
        text.safe_name(F.concat("p_name", F.lit("/"), "p_brand")).alias("safe_name"),
        text.normalised(F.lit(""), F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("normal"),
        text.short_label(F.concat("p_brand", F.lit(" （"), "p_type", F.lit("）"))).alias("short_label"),
        text.view_role(label).alias("role"),
        text.view_role(F.concat(F.lit("the top of "), "p_name"), exact=False).alias("loose_role"),
    )


def q41_parent_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    structure = F.when(F.col("p_size") > 20, F.col("p_brand"))
    return parts.select("p_partkey", text.parent_report(F.col("p_name"), F.col("p_type"), structure, F.split("p_name", " ")).alias("report"))


def q42_pages_and_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    pages = text.page_labels(F.col("c_name"), F.col("c_nationkey") % 4)
    pairs = text.paired(F.array("c_name", "c_mktsegment", F.lit("x")), F.slice(F.array(F.lit("Top"), F.lit("Front"), F.lit("Side")), F.lit(1), F.col("c_nationkey") % 3 + 1))
    return customers.select(
        "c_custkey",
        F.array_join(pages, "|").alias("pages"),
        F.array_join(F.transform(pairs, lambda p: F.concat(p["file"], F.lit("="), p["label"])), "|").alias("pairs"),
        text.data_uri(F.col("c_name").cast("binary")).alias("uri"),
    )


def q43_entry_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", text.entry_id(F.col("ts"), F.concat("event_type", F.lit(".v1.png"))).alias("entry_id"))


def q44_confirmed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("name"))
    found = analysis.confirmed_symbols(hits, "conv_id")
    return found.select("conv_id", F.array_join("symbols", ",").alias("symbols"), F.array_join("anchors", ",").alias("anchors"))


def q45_feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)).alias("bend_lines"), F.regexp_extract_all("text", F.lit("@"), F.lit(0)).alias("holes"))
    return analysis.counts(docs).select("doc_id", "has_bends", "hole_count")


def q46_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agents' candidate codes that parts carry: a letter by their key and a number by their size."""
    code = F.concat(F.substring(F.lit("CDEFHIKOQ"), F.col("p_partkey").cast("int") % 9 + 1, F.lit(1)), F.lpad((F.col("p_size") % 30).cast("string"), 2, "0"))
    met = table(spark, sf_dir, "part").select("p_partkey", code.alias("code")).join(F.broadcast(analysis.agents(spark)), "code")
    return met.groupBy("domain", "code").agg(F.count("*").alias("n_parts"), F.min("p_partkey").alias("first_part"))


def q47_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, F.concat(F.lit(" "), "c_mktsegment")).otherwise(F.lit("  ")).alias("locked_notes"), F.when(F.col("c_nationkey") > 3, F.col("c_name")).alias("typed_notes"))
    return analysis.request(asked).select("c_custkey", "notes")


def q48_named_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("role").alias("name"), "turn")).alias("symbols"))
    return reports.named_symbol(symbols, "USER").select("conv_id", "found", F.size("symbols").alias("n"))


def q49_title_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as recognised lines at places made of their numbers, on images of 100 by 80."""
    x, y = (F.col("turn") * 37 + F.col("conv_id")) % 100, (F.col("conv_id") * 53 + F.col("turn") * 7) % 80
    corner = lambda dx, dy: F.array((x + dx).cast("double"), (y + dy).cast("double"))
    lines = table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("line"), "text", ((F.col("turn") % 10) / 10).alias("confidence"), F.lit(100).alias("w0"), F.lit(80).alias("h0"),
        F.array(corner(0, 0), corner(9, 0), corner(9, 4), corner(0, 4)).alias("polygon"),
    )
    found = boxes.title_block(lines, "conv_id", "w0", "h0", share=0.5, least=0.1)
    return found.select("conv_id", F.col("region.x").alias("x"), F.col("region.y").alias("y"), F.array_join("texts", ",").alias("texts"), F.size("notes").alias("n_notes"))


def q50_most_used_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.most_used(documents(spark, sf_dir, searched=True), 10, ("tion", "ment", "ung", "ción", "the", "License", "zzzz"))


def q51_mean_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "error", F.round("value", 0)).alias("improvement_rate"))
    return evaluate.mean_improvement(events)


def q52_store_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cases: those of one type have metrics, and some of these no time of their own."""
    rates = F.struct(F.col("value").alias("v1_distance"), F.lit(0.0).alias("v2_distance"), F.lit(None).cast("double").alias("improvement_rate"), F.when(F.col("user_id") > 20, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"))
    cases = table(spark, sf_dir, "events").select(F.col("event_id").alias("entry_id"), F.when(F.col("user_id") > 10, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"), F.when(F.col("event_type") == "click", rates).alias("rag_metrics"))
    return store.metric_history(cases).select("entry_id", "ordinal", "time", "v1_distance")


def q53_upsert_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are the stored cases; labelled ones are stored again, twice if they are toxic, some without a hash."""
    nothing = F.lit(None).cast("string")
    cases = documents(spark, sf_dir).withColumns({"updated_at": nothing, "version_count": F.lit(1), "status": nothing, "superseded_by": F.lit(None).cast("bigint"), "bom_context": nothing, "version_history": F.array().cast(STEP)}).drop("lang", "notes")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("entry_id"), "toxic", "quality")
    again = documents(spark, sf_dir).join(labels, "entry_id").withColumn("time", F.explode(F.sequence(F.lit(0), F.col("toxic"))))
    number = F.col("entry_id") * 2 + F.col("time") + 10_000_000
    batch = again.select(
        number.alias("entry_id"), number.alias("seq"), F.when((F.col("quality") == 1) | (F.col("toxic") == 1), F.col("image_hash")).otherwise(F.lit(" ")).alias("image_hash"),
        F.concat(F.lit("again "), number.cast("string")).alias("description"), F.lit("").alias("reasoning"), F.col("lang").alias("bom_context"),
    )
    steps = F.array_join(F.transform("version_history", lambda s: F.concat(F.left(s["timestamp"], F.lit(10)), F.lit(" "), F.md5(s["description_snapshot"]))), "|")
    return store.upsert(cases, batch, NOW).select("entry_id", "version_count", "bom_context", steps.alias("history"), F.md5("description").alias("description_hash"))


def q54_shadow_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as shadow records, of which the low ones have a truth; files are the documents in German and English."""
    labels = table(spark, sf_dir, "labels")
    log = labels.select(
        F.concat(F.lit("p"), "doc_id").alias("image_path"), F.lit("seen").alias("description"), F.when(F.col("quality") == 0, text.texts(["B1", "A2"])).otherwise(text.texts([])).alias("ground_truth"),
        F.when(F.col("toxic") == 1, text.texts(["A2"])).otherwise(text.texts([])).alias("missing"), text.texts([]).alias("wrong"),
    )
    files = documents(spark, sf_dir).where("lang IN ('de', 'en')").select(F.concat(F.lit("p"), "entry_id").alias("path"))
    return store.exported(log, files).select("image_path", "description", F.array_join("correct_processes", ",").alias("correct_processes"), "reasoning", F.array_join("tags", ",").alias("tags"))


def q55_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entry_id"), F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("image_path"), F.when(F.col("c_acctbal") > 0, F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).alias("corrected"))
    files = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("path"))
    return store.reviewed(records, files).select("entry_id", "saved", "description")


def q56_parent_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as payloads whose features are an array, a text, a number, or missing."""
    rows = table(spark, sf_dir, "customer")
    kind = F.col("c_nationkey") % 4
    features = F.when(kind == 0, F.lit('["a", "b c"]')).when(kind == 1, F.lit('"one, text"')).when(kind == 2, F.lit("7")).otherwise(F.lit("null"))
    payload = F.concat(F.lit('{"material": "'), "c_mktsegment", F.lit('", "material_spec": "'), F.when(F.col("c_acctbal") < 0, F.col("c_name")).otherwise(F.lit("")), F.lit('", "global_features": '), features, F.lit("}"))
    found = rules.parent_payload(rows.select("c_custkey", payload.alias("payload")))
    return found.select("c_custkey", "material", "structure", F.array_join("features", "|").alias("features"), "notes")


def q57_overridden_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = lambda key, parent, child: [F.col(key).cast("string").alias("group_id"), F.col(parent).alias("parent"), F.array(child).alias("children")]
    found = table(spark, sf_dir, "customer").select(*group("c_custkey", "c_name", "c_mktsegment"))
    stated = table(spark, sf_dir, "supplier").select(*group("s_suppkey", "s_name", "s_name"))
    return groups.overridden(found, stated).select("group_id", "parent", F.array_join("children", ",").alias("children"))


def q58_words_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(F.array_join(reports.in_order(F.split("text", " ")), " ")).alias("words_hash"))


def q59_parts_with_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("c_nationkey"), F.col("s_name").alias("bom"))
    return reports.with_notes(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), notes, "c_nationkey")


def q60_indexable(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("entry_id"), F.when(F.col("toxic") == 1, "superseded").alias("status"))
    cases = documents(spark, sf_dir).join(status, "entry_id", "left").withColumn("description", F.when(F.col("lang") != "fr", F.col("description"))).withColumn("reasoning", F.col("notes"))
    return store.indexable(cases).select("entry_id", F.md5("description").alias("text_hash"))


def q61_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"))
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("d"), F.col("page_id").cast("string")).alias("name"))
    return groups.existing(children, files)


def q62_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as regions: whether one is valid, its page in pixels, whether it is worth cropping, its box moved."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("w"), (F.col("l_linenumber") * 9).cast("double").alias("h"), F.col("l_discount").alias("x0"), F.col("l_tax").alias("x1"), F.col("l_linenumber").alias("x"), F.lit(2).alias("y"))
    size = boxes.page_size(F.col("w"), 200)
    found = boxes.moved(lines, 10, 20).select(
        "l_orderkey", "l_linenumber", "x", "y", boxes.valid_region(F.col("x0"), F.lit(0.0), F.col("x1"), F.lit(1.0)).alias("valid"), size["pixels"].alias("pixels"),
        boxes.worth_cropping(F.col("w"), F.col("h"), F.col("l_linenumber") - 1).alias("worth"),
    )
    return found


def q63_review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("<orange>"), "c_mktsegment", F.lit("</orange> and <red>"), "c_name", F.lit("</red> but <green>"), "c_name", F.lit("</green>"))
    warned = F.when(F.col("c_acctbal") < 0, F.array("c_mktsegment", F.lit("no thickness")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.review_list(marked, warned).alias("r"), text.retrieval_allowed(F.col("c_acctbal") > 100, F.col("c_nationkey") > 5).alias("similar"))
    return rows.select("c_custkey", F.array_join("r", "|").alias("review"), "similar")


QUERIES = {name: f for name, f in list(globals().items()) if name[0] == "q" and name[1:3].isdigit()}

_PRIMARY = "('" + "', '".join(fixed.PRIMARY_VIEWS) + "')"
_AGENTS = ", ".join(f"('{domain}', '{code}')" for domain, codes in analysis.AGENT_CODES.items() for code in codes)

ORACLE_SQL = {
    "q40_names": f"""SELECT p_partkey, coalesce(nullif(CASE WHEN p_size > 10 THEN p_type END, ''), nullif(left(p_name, 40), ''), '(untitled)') AS title, p_name AS file_name, replace(p_name || '_' || p_brand, ' ', '_') AS safe_name,
        lower(p_brand) AS normal, p_brand AS short_label, CASE WHEN (CASE WHEN p_size > 25 THEN 'Top' ELSE p_type END) IN {_PRIMARY} THEN 'primary' ELSE 'supporting' END AS role, 'primary' AS loose_role FROM part""",
    "q41_parent_report": "SELECT p_partkey, concat_ws(' / ', '零件名稱：' || p_name, '材質：' || p_type, CASE WHEN p_size > 20 THEN '結構：' || p_brand END, '特徵：' || replace(p_name, ' ', ', ')) AS report FROM part",
    "q42_pages_and_pairs": """SELECT c_custkey, CASE WHEN c_nationkey % 4 > 1 THEN array_to_string(list_transform(range(1, c_nationkey % 4 + 1), lambda i: c_name || ' (page ' || i || ')'), '|') WHEN c_nationkey % 4 = 1 THEN c_name ELSE '' END AS pages,
        array_to_string(list_transform(range(1, c_nationkey % 3 + 2), lambda i: [c_name, c_mktsegment, 'x'][i] || '=' || ['Top', 'Front', 'Side'][i]), '|') AS pairs, 'data:image/png;base64,' || base64(c_name::BLOB) AS uri FROM customer""",
    "q43_entry_ids": "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') || '_' || event_type AS entry_id FROM events",
    "q44_confirmed_symbols": """SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS symbols, string_agg(DISTINCT '[CV-CONFIRMED] ' || role, ',' ORDER BY '[CV-CONFIRMED] ' || role) AS anchors FROM conversations GROUP BY conv_id""",
    "q45_feature_counts": "SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) > 0 AS has_bends, len(regexp_extract_all(text, '@'))::INT AS hole_count FROM documents",
    "q46_agents": f"""SELECT domain, v.code, count(*) AS n_parts, min(p_partkey) AS first_part FROM (VALUES {_AGENTS}) v(domain, code)
        JOIN part ON v.code = substr('CDEFHIKOQ', (p_partkey % 9)::INT + 1, 1) || lpad((p_size % 30)::VARCHAR, 2, '0') GROUP BY domain, v.code""",
    "q47_requests": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_mktsegment WHEN c_nationkey > 3 THEN c_name ELSE '' END AS notes FROM customer",
    "q48_named_symbol": "SELECT conv_id, count(*) FILTER (role = 'user') > 0 AS found, count(*) FILTER (role = 'user')::INT AS n FROM conversations GROUP BY conv_id",
    "q49_title_block": f"""SELECT conv_id, 50 AS x, 40 AS y, string_agg(text, ',' ORDER BY turn, text) AS texts, count(*) FILTER ({_NOTES_SQL})::INT AS n_notes FROM conversations
        WHERE (turn * 37 + conv_id) % 100 >= 50 AND (conv_id * 53 + turn * 7) % 80 >= 40 AND (turn % 10) / 10 >= 0.1 GROUP BY conv_id""",
    "q50_most_used_terms": """WITH terms(i, term) AS (VALUES (1, 'tion'), (2, 'ment'), (3, 'ung'), (4, 'ción'), (5, 'the'), (6, 'License'), (7, 'zzzz')),
        used AS (SELECT i, term, count(*) AS n_entries FROM terms JOIN documents ON contains(lower(text), lower(term)) GROUP BY i, term)
        SELECT row_number() OVER (ORDER BY n_entries DESC, i)::INT AS rank, term, n_entries FROM used ORDER BY rank LIMIT 10""",
    "q51_mean_improvement": "SELECT count(*) AS n, round(avg(round(value, 0)), 4) AS mean_improvement FROM events WHERE event_type <> 'error' AND value IS NOT NULL",
    "q52_store_metrics": """WITH known AS (SELECT event_id AS entry_id, CASE WHEN user_id > 10 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS time, value AS v1_distance FROM events WHERE event_type = 'click' AND value IS NOT NULL)
        SELECT entry_id, row_number() OVER (ORDER BY time NULLS LAST, entry_id) AS ordinal, time, v1_distance FROM known""",
    "q53_upsert_history": f"""WITH {DOCS_SQL},
        again AS (SELECT c.*, l.toxic, l.quality, unnest(range(0, l.toxic + 1)) AS t FROM cases c JOIN labels l ON l.doc_id = c.entry_id),
        batch AS (SELECT entry_id * 2 + t + 10000000 AS id, CASE WHEN quality = 1 OR toxic = 1 THEN image_hash ELSE 'own ' || (entry_id * 2 + t + 10000000) END AS k, lang FROM again),
        incoming AS (SELECT k, count(*) AS n, min(id) AS first_id, max(id) AS last_id, arg_max(lang, id) AS lang, string_agg('|2026-01-00 ' || md5('again ' || id), '' ORDER BY id) AS all_steps FROM batch GROUP BY k),
        last AS (SELECT image_hash AS k, max(entry_id) AS top FROM cases GROUP BY image_hash)
        SELECT c.entry_id, CASE WHEN n IS NOT NULL AND c.entry_id = top THEN 1 + n ELSE 1 END::INT AS version_count, CASE WHEN n IS NOT NULL AND c.entry_id = top THEN i.lang END AS bom_context,
               CASE WHEN n IS NOT NULL AND c.entry_id = top THEN '2026-01-00 ' || md5(left(description, 200)) || left(all_steps, 44 * (n - 1)::INT) ELSE '' END AS history,
               md5(CASE WHEN n IS NOT NULL AND c.entry_id = top THEN 'again ' || last_id ELSE description END) AS description_hash
        FROM cases c LEFT JOIN incoming i ON i.k = c.image_hash LEFT JOIN last l ON l.k = c.image_hash
        UNION ALL SELECT first_id, n::INT, lang, '', md5('again ' || last_id) FROM incoming WHERE k NOT IN (SELECT k FROM last)""",
    "q54_shadow_export": """SELECT 'p' || l.doc_id AS image_path, 'seen' AS description, 'B1,A2' AS correct_processes, '[Shadow Test] ground_truth=[B1, A2]  missing=[' || CASE WHEN toxic = 1 THEN 'A2' ELSE '' END || ']  wrong=[]' AS reasoning, 'shadow_test' AS tags
        FROM labels l JOIN documents d USING (doc_id) WHERE quality = 0 AND lang IN ('de', 'en')""",
    "q55_reviewed": "SELECT c_custkey AS entry_id, n_nationkey IS NOT NULL AS saved, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END AS description FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3",
    "q56_parent_payload": """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_name ELSE c_mktsegment END AS material, '' AS structure, ['a|b c', 'one, text', '', ''][c_nationkey % 4 + 1] AS features, '' AS notes FROM customer""",
    "q57_overridden_groups": """SELECT c_custkey::VARCHAR AS group_id, c_name AS parent, c_mktsegment AS children FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
        UNION ALL SELECT s_suppkey::VARCHAR, s_name, s_name FROM supplier""",
    "q58_words_in_order": """WITH words AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
        firsts AS (SELECT doc_id, word, min(i) AS i FROM words GROUP BY doc_id, word)
        SELECT doc_id, md5(string_agg(word, ' ' ORDER BY i)) AS words_hash FROM firsts GROUP BY doc_id""",
    "q59_parts_with_notes": "SELECT c_custkey, c_nationkey, coalesce(bom, '') AS bom FROM customer LEFT JOIN (SELECT s_nationkey, min(s_name) AS bom FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey) ON s_nationkey = c_nationkey",
    "q60_indexable": "SELECT d.doc_id AS entry_id, md5(CASE WHEN lang <> 'fr' AND text <> '' THEN text ELSE source END) AS text_hash FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(toxic, 0) <> 1",
    "q61_existing": "SELECT 'd' || doc_id AS name, doc_id IN (SELECT page_id FROM pages) AS exists FROM labels",
    "q62_regions": """SELECT l_orderkey, l_linenumber, l_linenumber + 10 AS x, 22 AS y, l_discount >= 0 AND l_discount < l_tax AND l_tax <= 1 AS valid, floor(l_quantity * 200 / 72)::BIGINT AS pixels,
        l_quantity > (l_linenumber * 9)::DOUBLE * 1.2::DOUBLE AND l_linenumber = 1 AS worth FROM lineitem""",
    "q63_review_list": """SELECT c_custkey, c_name || '|' || c_mktsegment || CASE WHEN c_acctbal < 0 THEN '|no thickness' ELSE '' END AS review, c_acctbal > 100 AND c_nationkey > 5 AS similar FROM customer""",
}
