"""Registered queries: each takes (spark, folder) and covers whole tables."""

import uuid

from pyspark.sql import functions as F

from leafwise.functions.text import file_stem, split_sentences, strip_ws, tokenize
from leafwise.functions.vectors import cosine_similarity
from leafwise.operators import exporting, lookup, maintenance, matching, parsing, positions, ranking, scoring
from leafwise.operators import indexing as ix
from leafwise.operators.cells import MAX_CELLS, ann_knn, assign_cells, fit_cells
from leafwise.operators.learned import learn_encoder
from leafwise.operators.neighbours import knn_expression, knn_top_k
from leafwise.operators.summarizing import rank_sentences, sentence_pool, summary_context
from leafwise.operators.parsing import parse_documents as parse
from leafwise.plans import search as s
from leafwise.plans.staging import shared_dir, stage
from leafwise.plans.summaries import summarize
from leafwise.sources import documents as stored
from leafwise.sources import tables
from leafwise.sources.corpus import read_corpus, read_table
from workload.inputs import (
    ENCODER,
    EXPORTS,
    REQUESTS,
    from_sql,
    index,
    paged_queries,
    parsed,
    queries,
    reports,
)


def joined(column):
    return F.array_join(column, " | ").alias(column)


def score(digits=6):
    return F.round("score", digits).alias("score")


def corpus(spark, folder):
    return read_corpus(spark, folder)


def file_types(spark, folder):
    return parsing.classify_files(reports(spark, folder)).drop("text")


def assemble_parts(spark, folder):
    kind = F.when(F.col("conv_id") % 2 == 0, "pdf").otherwise("docx")
    parts = read_table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("file_path"),
        kind.alias("file_type"),
        F.col("turn").alias("part_no"),
        "text",
    )
    return parsing.assemble_parts(parts)


def latest_upsert(spark, folder):
    events = read_table(spark, folder, "events")
    click = F.col("event_type") == "click"
    new = events.filter(~click | click.isNull())
    return maintenance.upsert_documents(events.filter(click), new, "user_id", ["ts", "event_id"])


def document_table(spark, folder):
    """A stored table: every other document has another text at first, text files are deleted, old and new are folded."""
    documents = stage(parsed(spark, folder).withColumn("embedding", F.lit(None).cast("array<float>")), "documents")
    late = F.pmod(F.xxhash64("id"), F.lit(2)) == 1
    path = f"{shared_dir(spark)}/leafwise/{uuid.uuid4().hex}/table"
    stored.create_table_if_absent(spark, path, buckets=stored.buckets_for(documents))
    stored.append_batch(documents.withColumn("content", F.when(late, F.lit("text that goes")).otherwise(F.col("content"))), path, 0)
    stored.compact(spark, path)
    stored.append_batch(documents.filter(late), path, 1)
    stored.delete_documents(spark, path, F.col("file_type") == "txt", 0)
    return stored.read_documents(spark, path).select("id", "file_type", "title", "content")


def ingest_report(spark, folder):
    return parsing.ingest_report(parsing.parse_status(reports(spark, folder)))


def parse_status(spark, folder):
    return parsing.parse_status(reports(spark, folder))


def ingest_message(spark, folder):
    return parsing.ingest_message(ingest_report(spark, folder))


def delete_where(spark, folder):
    return maintenance.delete_where(read_table(spark, folder, "events"), F.col("value") > 50)


def headings(spark, folder):
    docs = parsed(spark, folder)
    return docs.select("id", F.explode("headings").alias("heading"))


def sections(spark, folder):
    return parsed(spark, folder).select("id", "background", "scope")


def parse_documents(spark, folder):
    docs = parsed(spark, folder)
    return docs.select(
        "id", "title", "file_path", "file_type", joined("headings"), "background", "scope", "content", "category"
    )


def parse_documents_cut(spark, folder):
    """With the limits of an index of small documents: 5000 characters of content, 20 headings."""
    docs = parse(reports(spark, folder), content_chars=5000, max_headings=20)
    return docs.select("id", "title", joined("headings"), "content")


def parts_documents(spark, folder):
    parts = assemble_parts(spark, folder)
    path = F.concat_ws(".", F.concat(F.lit("talk-"), "file_path"), "file_type")
    files = parts.select(path.alias("file_path"), "text")
    docs = parsing.parse_documents(files)
    return docs.select("id", "title", "file_type", joined("headings"), "background", "scope", "content")


def embedding_text(spark, folder):
    return parsed(spark, folder).select("id", parsing.embedding_text().alias("text"))


def document_ids(spark, folder):
    path = F.col("file_path")
    return reports(spark, folder).select("file_path", file_stem(path).alias("id"))


def stripped_lines(spark, folder):
    lines = read_table(spark, folder, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    return lines.select("doc_id", F.col("line_no").cast("bigint"), strip_ws(F.col("line")).alias("line"))


def tokens(spark, folder):
    texts = read_table(spark, folder, "documents").select(
        "doc_id", F.posexplode(tokenize(F.col("text"))).alias("pos", "token")
    )
    return texts.select("doc_id", F.col("pos").cast("bigint"), "token")


def sentences(spark, folder):
    texts = read_table(spark, folder, "documents").select(
        "doc_id", F.posexplode(split_sentences(F.col("text"))).alias("pos", "sentence")
    )
    return texts.select("doc_id", F.col("pos").cast("bigint"), "sentence")


def postings(spark, folder):
    return ix.build_postings(parsed(spark, folder))


def positional_postings(spark, folder):
    found = positions.positional_postings(parsed(spark, folder))
    return found.select("field", "term", "doc_id", F.array_join("gaps", " ").alias("gaps"))


def phrases(spark, folder):
    """Where each run of three words of a query text stands in the documents."""
    i = index(spark, folder)
    words = queries(spark, folder).select(tokenize(F.col("query")).alias("w")).filter("size(w) > 2")
    runs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda p: F.array_join(F.slice("w", p, 3), " "))).alias("phrase"))
    postings = stage(positions.positional_postings(i.documents), "positions")
    found = positions.phrase_matches(runs.distinct(), postings, i.term_stats)
    return found.select("phrase", "field", "doc_id", F.array_join("starts", " ").alias("starts"))


def term_stats(spark, folder):
    return ix.term_stats(ix.build_postings(parsed(spark, folder)))


def term_stats_in_batches(spark, folder):
    """Statistics of a stored index: every other document has another text at first, which a second batch replaces."""
    documents = stage(parsed(spark, folder), "documents")
    late = F.pmod(F.xxhash64("id"), F.lit(2)) == 1
    path = f"{shared_dir(spark)}/leafwise/{uuid.uuid4().hex}/index"
    early = documents.withColumn("content", F.when(late, F.lit("text that goes")).otherwise(F.col("content")))
    tables.write_index(early, path, ENCODER, buckets=4)
    tables.add_to_index(documents.filter(late), path, ENCODER)
    found = tables.read_index(spark, path)
    # postings and statistics are kept apart; both must be those of one build
    counted = ix.term_stats(found.postings)
    return counted.join(found.term_stats, ["field", "term", "df"]).select("field", "term", "df")


def field_stats(spark, folder):
    stats = ix.field_stats(ix.build_postings(parsed(spark, folder)))
    return stats.select("field", "n_docs", F.round("avgdl", 6).alias("avgdl"))


def hash_embedding(spark, folder):
    vectors = ix.embed_documents(parsed(spark, folder), ENCODER)
    values = vectors.select("id", F.posexplode("embedding").alias("dim", "value"))
    return values.select("id", F.col("dim").cast("bigint"), F.round(F.col("value").cast("double"), 6).alias("value"))


def query_terms(spark, folder):
    return matching.query_terms(matching.with_defaults(paged_queries(spark, folder)))


def _expansions(spark, folder, table=queries, expand=matching.fuzzy_expand):
    asked = matching.with_defaults(table(spark, folder))
    i = index(spark, folder)
    return stage(expand(matching.query_terms(asked), i.term_stats), "query_expansions")


def fuzzy_expand(spark, folder):
    return _expansions(spark, folder).select(
        "query_id", "field", "term", "mult", "expansion", F.round("weight", 6).alias("weight"), "df"
    )


def _field_scores(spark, folder, expand):
    i = index(spark, folder)
    return scoring.bm25_score(_expansions(spark, folder, expand=expand), i.postings, i.field_stats)


def bm25(spark, folder):
    scores = _field_scores(spark, folder, matching.fuzzy_expand)
    return scores.select("query_id", "field", "doc_id", score())


def bm25_exact(spark, folder):
    scores = _field_scores(spark, folder, matching.exact_terms)
    return scores.select("query_id", "field", "doc_id", score())


def best_fields(spark, folder):
    scores = scoring.best_fields(_field_scores(spark, folder, matching.fuzzy_expand))
    return scores.select("query_id", "doc_id", score())


def _keyword_scores(spark, folder, table=queries, fuzzy=True):
    i = index(spark, folder)
    terms = matching.query_terms(matching.with_defaults(table(spark, folder)))
    return scoring.keyword_scores(terms, s.expand(terms, i, fuzzy), i.postings, i.field_stats)


def keyword_scores(spark, folder):
    scores = _keyword_scores(spark, folder, paged_queries)
    return scores.select("query_id", "doc_id", score())


def match_all(spark, folder):
    asked = matching.with_defaults(paged_queries(spark, folder))
    return scoring.match_all(asked, parsed(spark, folder))


def _vectors(spark, folder):
    return read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def cosine(spark, folder):
    vectors = read_table(spark, folder, "embeddings")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    value = F.round(cosine_similarity(F.col("embedding"), F.col("next")), 6)
    return vectors.join(following, "vec_id").select("vec_id", value.alias("cosine"))


def _vector_queries(spark, folder):
    return read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def knn(spark, folder):
    found = knn_top_k(_vectors(spark, folder), _vector_queries(spark, folder))
    return found.select("query_id", "doc_id", score())


def knn_pairs(spark, folder):
    vectors = read_table(spark, folder, "embeddings")
    pairs = vectors.select(F.col("vec_id").alias("doc_id"), F.col("label").cast("bigint").alias("query_id"))
    found = knn_expression(_vectors(spark, folder), _vector_queries(spark, folder), pairs)
    return found.select("query_id", "doc_id", score())


def ann(spark, folder):
    found = ann_knn(_vectors(spark, folder), _vector_queries(spark, folder))
    return found.select("query_id", "doc_id", score())


def ann_all_cells(spark, folder):
    """Every cell read and every vector a candidate: codes decide nothing, and the exact scores are those of ``knn``."""
    vectors = _vectors(spark, folder)
    found = ann_knn(vectors, _vector_queries(spark, folder), num_candidates=vectors.count(), probes=MAX_CELLS)
    return found.select("query_id", "doc_id", score())


def vector_cells(spark, folder):
    """The cell of every vector."""
    vectors = _vectors(spark, folder)
    return assign_cells(vectors, fit_cells(vectors)).select(F.col("id").alias("vec_id"), "cell")


def learned_neighbours(spark, folder):
    """The documents nearest to each query text by vectors learned from all documents."""
    i = index(spark, folder)
    terms = stage(ix.document_terms(i.documents), "document_terms")
    encoder = learn_encoder(terms)
    asked = queries(spark, folder).select("query_id", encoder(F.col("query")).alias("embedding"))
    found = knn_top_k(stage(encoder.of_terms(terms), "learned_vectors"), stage(asked, "learned_queries"))
    return found.select("query_id", "doc_id", score())


def _hits(spark, folder):
    i, asked = index(spark, folder), matching.with_defaults(queries(spark, folder))
    keyword = _keyword_scores(spark, folder)
    knn_hits = knn_top_k(i.vectors, s.query_vectors(asked, ENCODER))
    return scoring.hybrid_fuse(keyword, knn_hits)


def hybrid(spark, folder):
    return _hits(spark, folder).select("query_id", "doc_id", score())


def _pages(spark, folder):
    i, asked = index(spark, folder), matching.with_defaults(paged_queries(spark, folder))
    terms = matching.query_terms(asked)
    return s.search_pages(asked, i, ENCODER, terms, s.expand(terms, i))


def ranked_page(spark, folder):
    pages, _ = _pages(spark, folder)
    return pages.select("query_id", "rank", "doc_id", score())


def totals(spark, folder):
    _, totals = _pages(spark, folder)
    return totals


def keyword_page(spark, folder):
    asked = matching.with_defaults(queries(spark, folder))
    return ranking.rank_and_page(_keyword_scores(spark, folder, fuzzy=False), asked).select("query_id", "rank", "doc_id", score())


def search(spark, folder):
    found = s.search_documents(queries(spark, folder), index(spark, folder), ENCODER)
    return _flat(found)


def search_paged(spark, folder):
    found = s.search_documents(paged_queries(spark, folder), index(spark, folder), ENCODER)
    return _flat(found)


def _flat(found):
    fields = F.transform(
        F.map_entries("highlights"),
        lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], " | ")),
    )
    return found.withColumn("highlights", F.array_join(fields, " || ")).withColumn("score", score())


def highlights(spark, folder):
    found = s.search_documents(queries(spark, folder), index(spark, folder), ENCODER)
    found = stage(found.select("query_id", "id", "highlights"), "highlights")  # marked once, then taken apart
    fields = found.select("query_id", "id", F.explode("highlights").alias("field", "fragments"))
    return fields.select("query_id", "id", "field", F.posexplode("fragments").alias("no", "fragment")).withColumn(
        "no", F.col("no").cast("bigint")
    )


def snippets(spark, folder):
    found = s.search_documents(paged_queries(spark, folder), index(spark, folder), ENCODER)
    return found.select("query_id", "id", "snippet")


def present(spark, folder):
    found = s.search_documents(paged_queries(spark, folder), index(spark, folder), ENCODER)
    return exporting.present_results(found)


def _context(spark, folder):
    i = index(spark, folder)
    asked = matching.with_defaults(queries(spark, folder)).withColumn("limit", F.lit(5))
    terms = matching.query_terms(asked)
    pages, _ = s.search_pages(asked, i, ENCODER, terms, s.expand(terms, i))
    return stage(summary_context(pages.withColumnRenamed("doc_id", "id"), i.documents), "context")


def context(spark, folder):
    return _context(spark, folder)


def pool(spark, folder):
    return sentence_pool(_context(spark, folder))


def sentence_rank(spark, folder):
    pool = sentence_pool(_context(spark, folder))
    return rank_sentences(pool, queries(spark, folder), ENCODER).withColumn("score", score())


def summary(spark, folder):
    return summarize(queries(spark, folder), index(spark, folder), ENCODER)


def _fetched(spark, folder):
    return lookup.fetch_by_ids(parsed(spark, folder), from_sql(spark, folder, EXPORTS))


def fetch_by_ids(spark, folder):
    return _fetched(spark, folder).select("ord", "id", "title", "file_path", joined("headings"))


def resolve_ids(spark, folder):
    return lookup.resolve_document_ids(reports(spark, folder), from_sql(spark, folder, REQUESTS))


def export_csv(spark, folder):
    return exporting.export(_fetched(spark, folder), "csv")


def export_csv_cut(spark, folder):
    """With the limits of a printed table: 500 characters of a section, 5 headings."""
    return exporting.export_csv(_fetched(spark, folder), chars=500, max_headings=5)


def export_report_cut(spark, folder):
    """Paragraphs of 1000 characters at most."""
    return exporting.export_report_blocks(_fetched(spark, folder), chars=1000)


def export_report(spark, folder):
    return exporting.export(_fetched(spark, folder), "pdf")


def export_report_with_summary(spark, folder):
    return exporting.export(_fetched(spark, folder), "docx", include_summary=True)


REGISTERED = {
    f.__name__: f
    for f in (
        corpus,
        file_types,
        assemble_parts,
        parts_documents,
        latest_upsert,
        document_table,
        parse_status,
        ingest_report,
        ingest_message,
        delete_where,
        headings,
        sections,
        parse_documents,
        parse_documents_cut,
        embedding_text,
        document_ids,
        stripped_lines,
        tokens,
        sentences,
        postings,
        positional_postings,
        phrases,
        term_stats,
        term_stats_in_batches,
        field_stats,
        hash_embedding,
        query_terms,
        fuzzy_expand,
        bm25,
        bm25_exact,
        best_fields,
        keyword_scores,
        match_all,
        cosine,
        knn,
        knn_pairs,
        ann,
        ann_all_cells,
        vector_cells,
        learned_neighbours,
        hybrid,
        ranked_page,
        totals,
        keyword_page,
        search,
        search_paged,
        highlights,
        snippets,
        present,
        context,
        pool,
        sentence_rank,
        summary,
        fetch_by_ids,
        resolve_ids,
        export_csv,
        export_csv_cut,
        export_report_cut,
        export_report,
        export_report_with_summary,
    )
}
