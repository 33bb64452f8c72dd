"""Names of the implemented queries, with the SQL that says what each should return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions import sentence_model, text as T
from millrace.functions.lexicon import any_of, hits, vocabulary
from millrace.functions.tokens import SignTokens
from millrace.operators import chunks as C, claims as K, evaluate, layout as L, versions as V
from millrace.plans import sql
from millrace.sources import derived, reports as report_source, sinks

Query = Callable[[SparkSession, str], DataFrame]
SENT = ("doc_id", "page_number", "sent_idx")
BLOCK = ("doc_id", "page_number", "src_idx")
BOX = ("x0", "y0", "x1", "y1")
COUNTER = SignTokens()


def feats(spark: SparkSession, d: str) -> DataFrame:
    return K.features(K.sentences(derived.claim_pages(spark, d)))


def reasoned(spark: SparkSession, d: str) -> DataFrame:
    return K.with_reason(feats(spark, d))


def of_sentences(**columns) -> Query:
    """A query that gives some columns for each sentence."""
    return lambda spark, d: feats(spark, d).select(*SENT, *[make().alias(k) for k, make in columns.items()])


def predicate(reason: str) -> Query:
    return lambda spark, d: feats(spark, d).where(K.predicates(F.col("s"), F.col("low"), F.col("words"), F.col("quantity"))[reason]).select(*SENT)


def claims(spark: SparkSession, d: str) -> DataFrame:
    return K.claims(derived.claim_pages(spark, d))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return derived.layout_blocks(spark, d)


def tables(spark: SparkSession, d: str) -> DataFrame:
    return derived.layout_tables(spark, d)


def pages(spark: SparkSession, d: str) -> DataFrame:
    return derived.layout_pages(spark, d)


def headless(spark: SparkSession, d: str) -> DataFrame:
    return L.without_headers(blocks(spark, d), pages(spark, d))


def placed(spark: SparkSession, d: str) -> DataFrame:
    return C.ordered_items(blocks(spark, d), tables(spark, d), pages(spark, d))


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    return C.chunks(placed(spark, d))


def on_tables(spark: SparkSession, d: str, name: str, test) -> DataFrame:
    """A geometric test of each block against each boxed table of its page."""
    boxes = tables(spark, d).where("x0 is not null").select("doc_id", "page_number", *[F.col(c).alias(f"t_{c}") for c in BOX])
    pairs = blocks(spark, d).join(boxes, ["doc_id", "page_number"])
    return pairs.select(*BLOCK, test([F.col(c) for c in BOX], [F.col(f"t_{c}") for c in BOX]).alias(name))


def patterns(spark: SparkSession, d: str) -> DataFrame:
    line = T.first_line(T.stripped(F.col("text")))
    return blocks(spark, d).select(*BLOCK, T.is_caption(line).alias("caption"), T.is_list_item(line).alias("list_item"), T.is_page_number(T.clean(F.col("text"))).alias("page_no"))


def page_numbers(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).where(L.margin_of_block() & T.is_page_number(T.clean(F.col("text")))).select(*BLOCK)


def tables_of_pages(spark: SparkSession, d: str) -> DataFrame:
    found = tables(spark, d).select("doc_id", "page_number", "src_idx")
    return blocks(spark, d).select("doc_id", "page_number").distinct().join(found, ["doc_id", "page_number"], "left").groupBy("doc_id", "page_number").agg(F.count("src_idx").alias("tables"))


def summary(spark: SparkSession, d: str) -> DataFrame:
    return K.drop_counts(reasoned(spark, d)).groupBy("reason").agg(F.sum("n").alias("n"))


def noted_pages(spark: SparkSession, d: str) -> DataFrame:
    return derived.claim_pages(spark, d).unionByName(derived.order_notes(spark, d))


def sentence_ends(spark: SparkSession, d: str) -> sentence_model.SentenceModel:
    """Learned from every page, each text once: the known sentences come again and again."""
    return sentence_model.learned(noted_pages(spark, d).select("text").distinct(), sinks.kept)


def packing_trained(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's notes as one text, packed at 60 tokens between learned sentence ends."""
    notes = derived.order_notes(spark, d).join(derived.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey"), "doc_id")
    texts = notes.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda r: r["text"]), " ").alias("text"))
    split = sentence_ends(spark, d).split
    return texts.select("o_custkey", F.posexplode(C.packed(F.col("text"), COUNTER, 60, split)).alias("piece_idx", "text"))


def packing(spark: SparkSession, d: str) -> DataFrame:
    docs = derived.table(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("text"))
    return docs.select("doc_id", F.posexplode(C.packed(F.col("text"), COUNTER)).alias("piece_idx", "text"))


def token_windows(spark: SparkSession, d: str) -> DataFrame:
    found = derived.table(spark, d, "documents").where(COUNTER.count(F.col("text")) > C.MOST)
    return found.select("doc_id", F.posexplode(COUNTER.windows(F.col("text"), C.MOST, C.OVERLAP)).alias("window_idx", "text"))


def table_split(spark: SparkSession, d: str) -> DataFrame:
    """The grid of each supplier's lineitem rows, cut by rows."""
    cells = F.array(*[F.col(c).cast("long").cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")], F.col("l_returnflag"), F.col("l_linestatus"))
    item = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", cells.alias("cells"))
    grids = derived.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.transform(F.sort_array(F.collect_list(item)), lambda r: r["cells"]).alias("body"))
    head = F.array(F.array(*map(F.lit, ("order", "line", "part", "supplier", "quantity", "flag", "status"))))
    return grids.select("id", F.posexplode(C.split_table(F.concat(head, "body"), COUNTER)).alias("piece_idx", "piece")).select("id", "piece_idx", F.col("piece.text").alias("text"))


def nested_reports(spark: SparkSession, d: str) -> DataFrame:
    """Each report nested; its items are made once, for chunks and for warnings, and so is the list of pages."""
    p = sinks.kept(pages(spark, d), "pages")
    name = F.concat(F.lit("reports/doc-"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    meta = p.groupBy("doc_id").agg(F.max("page_number").alias("total_pages")).select("doc_id", name.alias("source_pdf"), F.lit("Acme").alias("company"), F.lit(2024).alias("year"), F.lit(None).cast("string").alias("report_type"), "total_pages")
    return C.reports(C.ordered_items(blocks(spark, d), tables(spark, d), p), blocks(spark, d), meta, p)


def chunk_fields(found: DataFrame) -> DataFrame:
    """Every field of every chunk of the reports, but the time."""
    rows = found.select("report_metadata.*", F.explode("chunks").alias("c"), F.size("extraction_warnings").alias("n_warnings"))
    return rows.select("source_pdf", "company", "year", "report_type", "total_pages", "n_warnings", *[f"c.{x}" for x in ("chunk_id", "page_number", "content_type", "text", "token_count", "heading_context")], *[F.col("c.bbox")[k].alias(x) for k, x in enumerate(BOX)])


def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """What comes back from JSON, an object to a line."""
    nested, folder = nested_reports(spark, d), sinks.scratch(spark, "reports-json")
    sinks.write_json(nested, folder, "gzip")  # text is four times as large
    return chunk_fields(sinks.read_json(spark, folder, nested.drop("doc_id").schema))


def json_files(spark: SparkSession, d: str) -> DataFrame:
    """What comes back from an indented JSON file for each report."""
    nested, folder = nested_reports(spark, d), sinks.scratch(spark, "report-files")
    sinks.write_json_files(nested, folder)
    return chunk_fields(sinks.read_json_files(spark, folder, nested.drop("doc_id").schema))


def json_variants(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of reports with fields that no schema names, by path; every third report has a remark, every chunk a score."""
    nested, folder = nested_reports(spark, d), sinks.scratch(spark, "reports-variant")
    score = F.transform("chunks", lambda c: c.withField("extra", F.struct((c["token_count"] * 2).alias("score"))))
    remark = F.when(F.col("doc_id") % 3 == 0, F.struct(F.lit("checked").alias("state")))
    sinks.write_json(nested.withColumns({"chunks": score, "remark": remark}), folder, "gzip")  # text is four times as large
    found = sinks.read_variants(spark, folder)
    get = lambda p, kind: F.try_variant_get("chunk", p, kind)
    state = F.try_variant_get("report", "$.remark.state", "string").alias("state")
    return sinks.variant_chunks(found, state).select("source_pdf", "total_pages", (F.col("pos") + 1).alias("number"), get("$.chunk_id", "string").alias("chunk_id"), get("$.content_type", "string").alias("content_type"), get("$.text", "string").alias("text"), get("$.bbox[1]", "double").alias("top"), get("$.extra.score", "int").alias("score"), get("$.nowhere", "string").alias("nowhere"), "state")


def observed_summary(spark: SparkSession, d: str) -> DataFrame:
    """The totals of ``summary``, observed while claims are written."""
    rows, told = K.observed(derived.claim_pages(spark, d))
    rows.write.parquet(sinks.scratch(spark, "claims"))
    return spark.createDataFrame(sorted(told.dropped().items()), "reason string, n long")  # a row for each reason


def distinct_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims and their different texts by topic, exact, and whether sketches kept for each report are within 5 % of it."""
    rows = claims(spark, d)
    kept = sinks.kept(K.text_sketches(rows, "Company", "ESG_Type"), "sketches")
    exact = rows.groupBy("ESG_Type").agg(F.count_distinct(F.lower("Claim_Text")).alias("exact"))
    near = F.abs(F.col("distinct_texts") - F.col("exact")) <= F.col("exact") * 0.05
    return K.merged_sketches(kept, "ESG_Type").join(exact, "ESG_Type").select("ESG_Type", "claims", F.col("exact").alias("distinct_texts"), near.alias("sketch_is_near"))


def stand_ins(spark: SparkSession, d: str, part: str) -> DataFrame:
    """What the report source gives of a folder of reports in a made-up format."""
    folder = sinks.scratch(spark, "reports")
    derived.write_stand_ins(spark, d, folder)
    report_source.register(spark, derived.parse_stand_in)
    return spark.read.format("report").option("part", part).load(folder).withColumn("report", sinks.stem(F.col("path")))


def page_files(spark: SparkSession, d: str) -> DataFrame:
    """name, text of the page text's file of each document."""
    folder = sinks.scratch(spark, "page-files")
    sinks.write_page_files(derived.claim_pages(spark, d), folder)
    return sinks.read_page_files(spark, folder)


def warnings(spark: SparkSession, d: str) -> DataFrame:
    return C.warnings(placed(spark, d), blocks(spark, d), pages(spark, d))


def risks(spark: SparkSession, d: str) -> DataFrame:
    low, quantity = F.col("low"), F.col("quantity")
    typed = feats(spark, d).select(*SENT, K.claim_type(low, quantity).alias("Claim_Type"), K.evidence(low, quantity).alias("Evidence_Exists"))
    return K.with_risk(typed).select(*SENT, "Risk_Signal")


def reports(spark: SparkSession, d: str) -> DataFrame:
    """An outline of each nested report."""
    nested = nested_reports(spark, d)
    outline = F.array_join(F.transform("chunks", lambda c: F.concat_ws(":", c["chunk_id"], c["content_type"])), ",")
    return nested.select("doc_id", F.size("chunks").alias("n_chunks"), outline.alias("outline"), F.col("report_metadata.total_pages").alias("total_pages"))


def tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    folder = sinks.scratch(spark, "claims-tsv")
    sinks.write_tsv(claims(spark, d), folder)
    return sinks.read_tsv(spark, folder, "Company string, Page int, Claim_Text string, ESG_Type string, Claim_Type string, Evidence_Exists string, Risk_Signal string")


def output_names(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("doc_id") % 5
    ending = F.when(kind == 0, ".tsv").when(kind == 1, ".CSV").when(kind == 2, ".Txt").when(kind == 3, ".pdf").otherwise("")
    return derived.table(spark, d, "documents").select("doc_id", F.concat("source", ending).alias("url")).withColumn("output", sinks.output_name(F.col("url")))


def gold(spark: SparkSession, d: str) -> DataFrame:
    """Gold rows with the topic of what was written down."""
    return derived.gold_rows(spark, d).withColumn("topic", K.esg_type(F.lower("original"))).drop("original")


def gold_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = claims(spark, d).select(F.col("Company").cast("long").alias("doc_id"), F.col("Claim_Text").alias("text"), F.col("ESG_Type").alias("topic"))
    return evaluate.recall(evaluate.found_gold(gold(spark, d), rows, ["doc_id"]), "topic")


def versioned(spark: SparkSession, d: str) -> DataFrame:
    return V.claims(V.first_of(V.judged(feats(spark, d))))


def version_gold(spark: SparkSession, d: str) -> DataFrame:
    """Recall and precision of each version on the gold rows."""
    names = F.array(*[F.lit(v.name) for v in V.VERSIONS])
    asked = gold(spark, d).withColumn("version", F.explode(names))
    return evaluate.recall(evaluate.found_gold(asked, versioned(spark, d), ["version", "doc_id"]), "version")


def judge_reliability(spark: SparkSession, d: str) -> DataFrame:
    """Of all three judges."""
    each = F.explode(F.array("reader", "length_rule", "tone_rule")).alias("answer")
    return evaluate.reliability(derived.judges(spark, d).select("lang", F.col("doc_id").alias("unit"), each), "lang")


def any_lists() -> dict:
    return {f"any_{x}": (lambda x=x: any_of(F.col("low"), x)) for x in vocabulary() if x != "section_nav_words"}


def scanned(spark: SparkSession, d: str) -> DataFrame:
    n = len(derived.golden())
    docs = derived.table(spark, d, "documents").select("doc_id", "text")
    known = F.broadcast(spark.createDataFrame([r[:2] for r in derived.golden()], "id int, sentence string"))  # 35 rows
    second = docs.join(known, F.col("id") == F.col("doc_id") % n + 1).select("doc_id", F.col("sentence").alias("text"))
    return L.scanned(docs.unionByName(second))


def queries() -> dict[str, Query]:
    low, quantity = F.col, lambda: F.col("quantity")
    hit = {k: (lambda name=name: hits(F.col("low"), name)) for k, name in (("topic", "topic_keywords"), ("social", "social_keywords"), ("governance", "governance_keywords"), ("headings", "section_nav_words"))}
    return {
        "claims": claims,
        "g01_sentences": lambda s, d: K.sentences(derived.claim_pages(s, d)),
        "g01_trained": lambda s, d: K.sentences(noted_pages(s, d), sentence_ends(s, d).split),
        "g02_trained": packing_trained,
        "p01_clean": of_sentences(s=lambda: F.col("s")),
        "p02_lower": of_sentences(low=lambda: F.col("low")),
        "p03_words": of_sentences(words=lambda: F.col("words")),
        "p04_quantity": of_sentences(quantity=quantity),
        "p05_numbers": of_sentences(numbers=lambda: T.number_count(F.col("s"))),
        "p06_page_mentions": of_sentences(mentions=lambda: T.page_mentions(F.col("low"))),
        "p07_any": of_sentences(**any_lists()),
        "p08_hits": of_sentences(**hit),
        "p09_nature": of_sentences(nature=lambda: F.rlike(low("low"), F.lit(T.NATURE)).cast("int")),
        "p10_workplace": of_sentences(workplace=lambda: F.rlike(low("low"), F.lit(T.WORKPLACE))),
        "p11_total_hits": of_sentences(total=lambda: K.environment_hits(low("low")) + hits(low("low"), "social_keywords") + hits(low("low"), "governance_keywords")),
        **{f"f{k:02d}_{r}": predicate(r) for k, r in enumerate(K.REASONS, 1)},
        "f11_duplicate": lambda s, d: K.repeated(reasoned(s, d)).select(*SENT),
        "cascade": lambda s, d: reasoned(s, d).select(*SENT, "reason"),
        "o01_first_seen": lambda s, d: K.first_seen(reasoned(s, d)).select(*SENT, "low"),
        "c01_claim_type": of_sentences(Claim_Type=lambda: K.claim_type(low("low"), quantity())),
        "c02_evidence": of_sentences(Evidence_Exists=lambda: K.evidence(low("low"), quantity())),
        "c03_risk": risks,
        "c04_esg_type": of_sentences(ESG_Type=lambda: K.esg_type(low("low"))),
        "a01_drop_counts": lambda s, d: K.drop_counts(reasoned(s, d)),
        "a02_type_counts": lambda s, d: K.type_counts(claims(s, d)),
        "s12_summary": summary,
        "s12_observed": observed_summary,
        "a02_levels": lambda s, d: K.level_counts(claims(s, d)),
        "a07_distinct_claims": distinct_claims,
        "s07_page_dump": lambda s, d: derived.claim_pages(s, d).select("doc_id", "page_number", sinks.page_dump().alias("dump")),
        "s08_tsv_round_trip": tsv_round_trip,
        "s10_output_names": output_names,
        "a06_scanned": scanned,
        "p12_patterns": patterns,
        "p13_first_line": lambda s, d: derived.table(s, d, "documents").select("doc_id", T.first_line(F.col("text")).alias("line")),
        "p14_token_count": lambda s, d: derived.table(s, d, "documents").select("doc_id", COUNTER.count(F.col("text")).alias("tokens")),
        "p15_chunk_id": lambda s, d: derived.table(s, d, "orders").select(F.col("o_orderkey").alias("number"), T.chunk_id(F.col("o_orderkey")).alias("chunk_id")),
        "p16_margin": lambda s, d: blocks(s, d).select(*BLOCK, L.margin_of_block().alias("margin")),
        "p17_iou": lambda s, d: on_tables(s, d, "iou", L.iou),
        "p18_contained": lambda s, d: on_tables(s, d, "inside", L.contained),
        "p19_markdown": lambda s, d: tables(s, d).select("doc_id", C.markdown(F.col("data")).alias("markdown")),
        "a03_block_fonts": lambda s, d: L.block_fonts(derived.spans(s, d)),
        "a04_page_fonts": lambda s, d: L.page_fonts(headless(s, d)),
        "a05_repeated_texts": lambda s, d: L.repeated_texts(blocks(s, d), pages(s, d)),
        "j01_uncovered": lambda s, d: L.uncovered(headless(s, d), tables(s, d)).select(*BLOCK),
        "j02_without_headers": lambda s, d: headless(s, d).select(*BLOCK),
        "j03_page_numbers": page_numbers,
        "j05_tables_of_pages": tables_of_pages,
        "o04_reading_order": lambda s, d: placed(s, d).select("doc_id", "page_number", "kind", "src_idx", F.row_number().over(L.in_order()).alias("place")),
        "c05_block_type": lambda s, d: placed(s, d).where("kind = 0").select(*BLOCK, "content_type"),
        "o02_heading_context": lambda s, d: placed(s, d).select(*BLOCK, "kind", "heading_context"),
        "g03_packing": packing,
        "g04_windows": token_windows,
        "g05_table_split": table_split,
        "chunks": lambda s, d: chunk_rows(s, d).select("doc_id", "number", "chunk_id", "page_number", "content_type", "text", "token_count", *[F.col("bbox")[k].alias(c) for k, c in enumerate(BOX)], "heading_context"),
        "o03_numbering": lambda s, d: chunk_rows(s, d).select("doc_id", "page_number", "kind", "src_idx", "number"),
        "a07_totals": lambda s, d: chunk_rows(s, d).groupBy("doc_id", "content_type").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens")),
        "a08_reports": reports,
        "a08_warnings": warnings,
        "s09_json_round_trip": json_round_trip,
        "s01_pages": lambda s, d: stand_ins(s, d, "pages").select("report", "page_number", "text", "status", "error"),
        "s04_tables": lambda s, d: stand_ins(s, d, "tables").select("report", "page_number", "src_idx", C.markdown(F.col("data")).alias("markdown"), *BOX),
        "s03_blocks": lambda s, d: report_source.blocks(derived.text_spans(s, d)),
        "s07_page_files": page_files,
        "s09_report_files": json_files,
        "s09_variants": json_variants,
        "a09_precision": lambda s, d: evaluate.precision(evaluate.judgements(s, d), "lang"),
        "a09_error_kinds": lambda s, d: evaluate.error_kinds(evaluate.judgements(s, d), "source"),
        "a09_pivot": lambda s, d: evaluate.pivoted(evaluate.judgements(s, d), "source", "lang", ["de", "en", "es", "fr"]),
        "a09_label_pairs": lambda s, d: evaluate.contingency(derived.table(s, d, "labels"), "quality", "toxic"),
        "a09_supported": lambda s, d: evaluate.supported(claims(s, d)),
        "a09_recall": gold_recall,
        "a09_agreement": lambda s, d: evaluate.agreement(derived.judges(s, d), "reader", "length_rule", "lang"),
        "a09_reliability": judge_reliability,
        "a09_versions": lambda s, d: V.progress(versioned(s, d)),
        "a09_version_changes": lambda s, d: V.changes(V.first_of(V.judged(feats(s, d)))),
        "a09_version_gold": version_gold,
    }


def oracle_sql() -> dict[str, str]:
    return sql.queries()
