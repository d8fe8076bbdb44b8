"""Ingestion: chunk tables, checked graph extraction, documents into chunks and graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.embed import embed, embed_remote
from skein.functions.text import PARAGRAPH_CHARS, SENTENCE_CHARS, paragraph_chunks, sentence_chunks, trim_white
from skein.operators.graph import merge
from skein.sources.clients import ChatClient, EmbeddingClient, ask
from skein.sources.tables import numbered, settled

# The types and levels that extraction may name.
TYPES = ("function", "class", "module", "concept", "api", "database", "theme")
LEVELS = ("low_level", "high_level")

EXTRACTION_PROMPT = (
    "Read the text and answer with one JSON object only: {\"entities\": [{\"name\", \"type\", \"level\", \"description\", \"tags\"}], "
    "\"relations\": [{\"source\", \"target\", \"relation\", \"weight\"}]}. "
    f"Types: {', '.join(TYPES)}. Levels: low_level for concrete things, high_level for themes. "
    "Every source and target is the name of an entity of yours; weight is between 0 and 1. At most 8 entities and 10 relations."
)


def chunks(docs: DataFrame, key: str, text: str, by: str = "sentence", size: int | None = None) -> DataFrame:
    """key, chunk_index, chunk_id, text, char_count of every document's chunks; blank documents have none."""
    make = {"sentence": (sentence_chunks, SENTENCE_CHARS), "paragraph": (paragraph_chunks, PARAGRAPH_CHARS)}[by]
    parts = make[0](F.coalesce(F.col(text), F.lit("")), size or make[1])
    rows = docs.select(F.col(key), F.posexplode(parts).alias("chunk_index", "text"))
    return rows.select(key, "chunk_index", F.concat_ws("-chunk-", F.col(key).cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "text", F.length("text").alias("char_count"))


def _list(keys: str | list[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _text(v: Column, path: str) -> Column:
    """A string field, null if it is anything else."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _number(v: Column, path: str) -> Column:
    """A number field of any type, null if it is anything else."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(v, path, "double"))


def validate_extraction(raw: DataFrame, keys: str | list[str] = "chunk_index", answer: str = "raw") -> DataFrame:
    """keys, error, entities, relations from JSON answers, each field checked.

    error: the answer is no JSON object. Entities need a name that is text; an unknown type or level becomes concept or
    low_level; a description that is no text becomes empty; tags keep text only. Relations need both ends as
    text among the names of the same answer, compared in lower case; a blank relation becomes relates_to; a weight outside
    0..1 or of another type becomes 0.5.
    """
    # A small file is one partition, and checking an answer costs far more than sending it.
    parts = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = raw.repartition(parts).withColumn("_v", F.try_parse_json(F.col(answer)))
    kind = F.schema_of_variant("_v")
    rows = rows.withColumn("_fine", F.coalesce(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(False)))
    listed = lambda v, f: F.coalesce(F.try_variant_get(v, f"$.{f}", "array<variant>"), F.array().cast("array<variant>"))
    one_of = lambda x, known, other: F.when(x.isin(*known), x).otherwise(other)

    # Fields are taken out first, so that each is looked up once however often its rule names it.
    def entity_fields(e: Column) -> Column:
        texts = [trim_white(_text(e, "$.name")).alias("name"), *(_text(e, f"$.{f}").alias(f) for f in ("type", "level", "description"))]
        return F.struct(*texts, F.filter(F.transform(listed(e, "tags"), lambda t: _text(t, "$")), lambda t: t.isNotNull()).alias("tags"))

    def entity(e: Column) -> Column:
        return F.struct(
            e["name"].alias("name"),
            one_of(e["type"], TYPES, "concept").alias("type"),
            one_of(e["level"], LEVELS, "low_level").alias("level"),
            F.coalesce(e["description"], F.lit("")).alias("description"),
            e["tags"].alias("tags"),
        )

    def relation_fields(r: Column) -> Column:
        named = trim_white(F.coalesce(_text(r, "$.relation"), F.lit(""))).alias("relation")
        return F.struct(_text(r, "$.source").alias("source"), _text(r, "$.target").alias("target"), named, _number(r, "$.weight").alias("weight"))

    def relation(r: Column) -> Column:
        return F.struct(
            r["source"].alias("source"),
            r["target"].alias("target"),
            F.when(r["relation"] == "", "relates_to").otherwise(r["relation"]).alias("relation"),
            F.when(r["weight"].between(0, 1), r["weight"]).otherwise(0.5).alias("weight"),
        )

    found = F.filter(F.transform(listed(F.col("_v"), "entities"), entity_fields), lambda e: F.coalesce(e["name"] != "", F.lit(False)))
    rows = rows.withColumn("_e", F.transform(found, entity))
    rows = rows.withColumn("_names", F.transform("_e", lambda e: F.lower(e["name"])))
    known = lambda n: F.coalesce(F.array_contains("_names", F.lower(n)), F.lit(False))
    kept = F.filter(F.transform(listed(F.col("_v"), "relations"), relation_fields), lambda r: known(r["source"]) & known(r["target"]))
    rows = rows.withColumn("_r", F.transform(kept, relation))
    fine = F.col("_fine")
    return rows.select(*_list(keys), F.when(~fine, "not a JSON object").alias("error"), F.when(fine, F.col("_e")).alias("entities"), F.when(fine, F.col("_r")).alias("relations"))


def listed_rows(checked: DataFrame, keys: str | list[str], items: str) -> DataFrame:
    """keys, place, item: one row for each entry of one of the lists.

    An outer explode and a filter on the entries: from a plain one Spark infers a filter on the list, pushes it down to the
    scan with the whole validation in it, and so validates every answer twice, the second time with no step shared.
    """
    return checked.select(*_list(keys), F.posexplode_outer(items).alias("place", "item")).where("item is not null")


def _placed(checked: DataFrame, keys: str | list[str], items: str) -> DataFrame:
    """seq and the fields of one of the lists, numbered in the order of keys and places; keys may be of any type that sorts."""
    order = [f"_k{i}" for i in range(len(_list(keys)))]
    named = listed_rows(checked.select(*(F.col(k).alias(o) for k, o in zip(_list(keys), order)), items), order, items)
    return numbered(named.select(*order, F.col("place").alias("_i"), "item.*"), [*order, "_i"], "seq").drop(*order, "_i")


def entity_rows(checked: DataFrame, keys: str | list[str] = "chunk_index") -> DataFrame:
    """seq, name, type, level, description, tags in the order of chunks and places."""
    return _placed(checked, keys, "entities").select("seq", "name", "type", "level", "description", "tags")


def relation_rows(checked: DataFrame, keys: str | list[str] = "chunk_index") -> DataFrame:
    """seq, source, target, relation, weight in the order of chunks and places."""
    return _placed(checked, keys, "relations").select("seq", "source", "target", "relation", "weight")


def extract_graph(docs: DataFrame, key: str, text: str, client: ChatClient) -> DataFrame:
    """Answers for every paragraph chunk, checked: key, chunk_index, error, entities, relations."""
    keys = [key, "chunk_index"]
    parts = chunks(docs, key, text, "paragraph").select(*keys, "text")
    asked = ask(parts, client, system=EXTRACTION_PROMPT, user="text", answer="raw", json=True)
    failed = F.col("error").alias("_failed")
    checked = validate_extraction(asked.select(*keys, failed, "raw"), [*keys, "_failed"])
    return checked.withColumn("error", F.coalesce("_failed", "error")).drop("_failed")


def ingest_documents(docs: DataFrame, key: str, text: str, nodes: DataFrame, edges: DataFrame, client: ChatClient | None = None, size: int | None = None, embedder: EmbeddingClient | None = None) -> dict[str, DataFrame]:
    """chunks (embedded; ``id`` is the chunk's id), nodes, edges and a report (one row a document).

    Document ids are numbers or text, and the chunks are what ``retrieve`` searches. The two stages fail on their own: a document
    whose extraction fails keeps its chunks, adds nothing to the graph and has the error in its report. A blank document has
    the error ``no text``. Without an ``embedder`` the hash embedder makes the vectors.
    """
    parts = chunks(docs, key, text, "sentence", size).withColumn("id", F.col("chunk_id"))
    made = settled(embed(parts) if embedder is None else embed_remote(parts, embedder), "chunks")
    report = docs.select(key, F.length(text).alias("total_chars"), F.when(trim_white(F.coalesce(F.col(text), F.lit(""))) == "", "no text").alias("error"))
    report = report.join(made.groupBy(key).agg(F.count("*").alias("chunks")), key, "left").fillna(0, ["chunks"])
    if client is None:
        return {"chunks": made, "nodes": nodes, "edges": edges, "report": report}
    checked = settled(extract_graph(docs, key, text, client), "extracted")
    failed = checked.groupBy(key).agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("chunk_index"))).alias("extraction_error"), F.sum(F.size("entities")).alias("entities"), F.sum(F.size("relations")).alias("relations"))
    # One failed chunk leaves the whole document out of the graph.
    good = checked.join(failed.where("extraction_error is null").select(key), key, "left_semi")
    keys = [key, "chunk_index"]
    every, joined, tally = merge(nodes, edges, entity_rows(good, keys), relation_rows(good, keys))
    return {"chunks": made, "nodes": every, "edges": joined, "tally": tally, "report": report.join(failed, key, "left")}
