"""The two-level knowledge graph: keyword scores, dual-level queries, relation paths, merging.

nodes: seq long, id, name, type, level, description, file_location, tags array<string>
edges: seq long, source, target, relation, weight double
prompts: query_id long, prompt string

``seq`` is the order of insertion; ties and fallbacks follow it.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from skein.functions.text import name_key, prompt_tokens, slugify, text_trigrams
from skein.sources.tables import bucketed, numbered, settled

LOW_HITS, HIGH_HITS, LOW_FALLBACK, HIGH_FALLBACK, PATHS_SHOWN = 5, 3, 3, 2, 4
WORD, GAP = r"[\p{L}\p{N}_#]+", r"[^\p{L}\p{N}_#]+"
PARTS = 32  # of the nodes that hold one trigram
LEVELS = {"low_level": (LOW_HITS, LOW_FALLBACK), "high_level": (HIGH_HITS, HIGH_FALLBACK)}


def node_text() -> Column:
    """What a prompt's words are looked up in: name, description and tags in lower case."""
    return F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit("")), F.concat_ws(" ", "tags")))


def _trigrams(nodes: DataFrame) -> DataFrame:
    part = F.pmod(F.xxhash64("seq"), F.lit(PARTS)).cast("int").alias("part")
    return nodes.select(F.explode(text_trigrams(node_text())).alias("trigram"), part, "seq")


def trigram_index(nodes: DataFrame, name: str | None = None) -> DataFrame:
    """trigram, part, seq: the inverted table of all three-character strings in the nodes' texts, in buckets by trigram and part.

    It serves any number of prompts; with a ``name`` it stays in the catalogue. A trigram's nodes are spread over PARTS parts, so that
    one that all nodes hold fills no bucket alone.
    """
    return bucketed(_trigrams(nodes), ["trigram", "part"], "trigrams", name=name)


def _term_hits(nodes: DataFrame, prompts: DataFrame, index: DataFrame | None) -> DataFrame:
    """query_id, seq, level, score of the nodes that a prompt's words hit.

    Each distinct word of all prompts looks up the nodes that hold its rarest trigram (none, if one of its trigrams is nowhere), and only
    those are read for the word. Prompts and nodes meet in equi-joins; the nodes are scanned once for the words, and once more for
    the trigrams of the prompts' words where there is no index.
    """
    terms = prompts.select("query_id", F.explode(prompt_tokens(F.col("prompt"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    wanted = terms.select("term").distinct().select("term", F.explode(text_trigrams(F.col("term"))).alias("trigram"))
    if index is None:
        index = settled(_trigrams(nodes).join(wanted.select("trigram").distinct(), "trigram", "left_semi"), "trigrams")
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    both = ["trigram", "part"]
    held = index.join(wanted.select("trigram").distinct().select("trigram", parts), both, "left_semi").groupBy("trigram").agg(F.count("*").alias("n"))
    rarest = wanted.join(held, "trigram", "left").groupBy("term").agg(F.min_by("trigram", F.struct("n", "trigram")).alias("trigram"), F.bool_or(F.col("n").isNull()).alias("nowhere"))
    found = index.join(rarest.where("not nowhere").select("term", "trigram", parts), both).select("seq", "term")
    texts = nodes.select("seq", "level", node_text().alias("_text"), F.lower(F.coalesce("name", F.lit(""))).alias("_name"))
    hits = texts.join(found, "seq").where(F.contains("_text", "term")).select("seq", "level", "term", F.when(F.contains("_name", "term"), 6).otherwise(2).alias("points"))
    return hits.join(terms, "term").groupBy("query_id", "seq", "level").agg(F.sum(F.col("points") * F.col("times")).cast("int").alias("score"))


def keyword_scores(nodes: DataFrame, prompts: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Nodes that a prompt's words hit: 2 for each word in name, description or tags, 4 more if in the name.

    ``index`` is the nodes' ``trigram_index``; without it only the trigrams that the prompts ask for are taken from the nodes.
    """
    return nodes.join(_term_hits(nodes, prompts, index).drop("level"), "seq")


def dual_level(nodes: DataFrame, prompts: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """query_id, level, rank, node columns, score, is_fallback.

    The best 5 low-level and 3 high-level hits by score; where a level has no hit, its first 3 or 2 nodes.
    """
    limit = F.when(F.col("level") == "low_level", LOW_HITS).otherwise(HIGH_HITS)
    order = Window.partitionBy("query_id", "level").orderBy(F.desc("score"), "seq")
    hits = _term_hits(nodes.where(F.col("level").isin(*LEVELS)), prompts, index)
    # A constant bound lets Spark limit each group before the shuffle; the level's own bound follows.
    hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LOW_HITS).where(F.col("rank") <= limit)
    hits = settled(hits.where(F.col("level").isin(*LEVELS)), "hits")  # at most eight rows a prompt
    out = nodes.join(hits.drop("level"), "seq").withColumn("is_fallback", F.lit(False))
    for level, (_, few) in LEVELS.items():
        first = nodes.where(F.col("level") == level).orderBy("seq").limit(few)  # at most three rows
        first = first.withColumn("rank", F.row_number().over(Window.partitionBy("level").orderBy("seq")))
        missed = prompts.select("query_id").join(hits.where(F.col("level") == level).select("query_id"), "query_id", "left_anti")
        spare = missed.crossJoin(F.broadcast(first)).withColumn("score", F.lit(0)).withColumn("is_fallback", F.lit(True))
        out = out.unionByName(spare)
    return out


def lay_out_edges(edges: DataFrame, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The edges twice, in buckets by source and by target, so that paths from either end find them without a shuffle of edges.

    With a ``name`` both stay in the catalogue as ``<name>_by_source`` and ``<name>_by_target``; ``insert_edges`` adds to them.
    """
    return tuple(bucketed(edges, end, f"by_{end}", name=name and f"{name}_by_{end}") for end in ("source", "target"))


def insert_edges(name: str, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables of ``lay_out_edges(edges, name)`` with the ``new`` edges put in; the layout stays."""
    spark, out = new.sparkSession, []
    for end in ("source", "target"):
        table = spark.table(f"{name}_by_{end}")
        buckets = int(spark.sql(f"DESCRIBE FORMATTED {name}_by_{end}").where("col_name = 'Num Buckets'").first().data_type)
        new.select(*table.columns).repartition(buckets, end).write.insertInto(f"{name}_by_{end}")
        out.append(spark.table(f"{name}_by_{end}"))
    return tuple(out)


def relational_paths(edges: DataFrame | tuple[DataFrame, DataFrame], selected: DataFrame) -> DataFrame:
    """query_id, seq, from, to, relation: edges with either end among ``selected(query_id, id)``, each once a query.

    ``edges`` is one table or the pair that ``lay_out_edges`` makes.
    """
    ids = selected.select("query_id", "id").distinct()
    pair = edges if isinstance(edges, tuple) else (edges, edges)
    ends = [table.join(ids.withColumnRenamed("id", end), end) for table, end in zip(pair, ("source", "target"))]
    every = ends[0].select("query_id", "seq", "source", "target", "relation").unionByName(ends[1].select("query_id", "seq", "source", "target", "relation"))
    return every.distinct().select("query_id", "seq", F.col("source").alias("from"), F.col("target").alias("to"), "relation")


def mentions(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """chunk_id, node_id, start, end: where chunks(chunk_id, text) name a node(seq, id, name), in code points, end exclusive.

    A name is a run of words (letters, digits, _ and #) in any case, whatever stands between them; of nodes with equal words the first by
    seq counts. Runs of words as long as some name has are looked up in an equi-join; a mention inside a longer one is dropped.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)
    named = nodes.select("seq", F.col("id").alias("node_id"), words(F.col("name")).alias("w")).where("size(w) > 0")
    names = named.groupBy(F.array_join("w", " ").alias("key")).agg(F.min(F.struct("seq", "node_id", F.size("w").alias("n"))).alias("x")).select("key", "x.node_id", "x.n")
    lengths = sorted(r.n for r in names.select("n").distinct().collect())  # few: numbers of words in a name
    # Gaps and words in turn: the lengths of all before a word give its place.
    parts = chunks.select("chunk_id", F.regexp_extract_all(F.lower("text"), F.lit(f"{WORD}|{GAP}"), 0).alias("p"))
    rows = parts.select("chunk_id", F.posexplode("p").alias("k", "part"))
    place = Window.partitionBy("chunk_id").orderBy("k")
    rows = rows.withColumn("end", F.sum(F.length("part")).over(place)).withColumn("start", F.col("end") - F.length("part")).where(F.col("part").rlike(f"^{WORD}$"))
    found = None
    for n in lengths:
        run = Window.partitionBy("chunk_id").orderBy("k").rowsBetween(0, n - 1)
        several = rows.select("chunk_id", "start", F.max("end").over(run).alias("end"), F.array_join(F.collect_list("part").over(run), " ").alias("key"), F.count("*").over(run).alias("size")).where(F.col("size") == n)
        hit = several.join(names.where(F.col("n") == n).select("key", "node_id"), "key").select("chunk_id", "node_id", "start", "end")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        kind = chunks.schema["chunk_id"].dataType.simpleString(), nodes.schema["id"].dataType.simpleString()
        return chunks.sparkSession.createDataFrame([], f"chunk_id {kind[0]}, node_id {kind[1]}, start long, end long")
    before = Window.partitionBy("chunk_id").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_reach", F.max("end").over(before)).where("_reach is null or _reach < end").drop("_reach")


def as_nodes(ranked: DataFrame, found: DataFrame) -> DataFrame:
    """A ranked list of chunks(query_id, id, text, rank) as one of the nodes they mention, so that it shares ids with the graph's.

    A node takes the rank of the best chunk that names it, and ranks close up in the order of rank, then id; a chunk without mentions keeps its own id.
    """
    named = found.select(F.col("chunk_id").alias("id"), "node_id").distinct()
    rows = ranked.join(named, "id", "left").withColumn("id", F.coalesce(F.col("node_id").cast("string"), F.col("id").cast("string")))
    best = rows.groupBy("query_id", "id").agg(F.min(F.struct("rank", "text")).alias("x"))
    order = Window.partitionBy("query_id").orderBy("x.rank", "id")
    return best.select("query_id", "id", F.col("x.text").alias("text"), F.row_number().over(order).alias("rank"))


def merge_nodes(nodes: DataFrame, entities: DataFrame, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new nodes, tally) for ``entities(seq, name, type, level, description, tags)``.

    An entity whose name, trimmed and in lower case, is known already is merged: the first one wins.
    A new node's id has its name's slug and its place among all nodes.
    """
    keyed = entities.withColumn("name_key", name_key(F.col("name")))
    known = nodes.select(name_key(F.col("name")).alias("name_key")).distinct()
    columns = ["seq", "name", "type", "level", "description", "tags"]
    first = keyed.groupBy("name_key").agg(F.min(F.struct(*columns)).alias("x"))
    fresh = first.join(known, "name_key", "left_anti").select("x.*")
    base = nodes.count()
    placed = numbered(fresh, ["seq", "name"]).withColumn("seq", F.col("n") + base)
    new = placed.select(
        "seq",
        F.concat_ws("-", F.lit("ing"), slugify(F.col("name")), F.col("seq").cast("string")).alias("id"),
        "name",
        "type",
        "level",
        "description",
        F.lit(label).cast("string").alias("file_location"),
        "tags",
    )
    tally = entities.agg(F.count("*").alias("all")).crossJoin(new.agg(F.count("*").alias("nodes_added")))
    return new, tally.select("nodes_added", (F.col("all") - F.col("nodes_added")).alias("nodes_merged"))


def merge_edges(nodes: DataFrame, edges: DataFrame, relations: DataFrame) -> DataFrame:
    """New edges source, target, relation, weight for ``relations(seq, source, target, relation, weight)`` by name.

    Names resolve to the first node of that name; a relation with an unknown end is dropped; a known
    (source, target, relation) is not added again, and of several the first weight counts.
    """
    ids = nodes.groupBy(name_key(F.col("name")).alias("key")).agg(F.min(F.struct("seq", "id")).alias("x")).select("key", F.col("x.id").alias("id"))
    keyed = relations.select("seq", name_key(F.col("source")).alias("s"), name_key(F.col("target")).alias("t"), "relation", "weight")
    ends = keyed.join(ids.select(F.col("key").alias("s"), F.col("id").alias("source")), "s").join(ids.select(F.col("key").alias("t"), F.col("id").alias("target")), "t")
    first = ends.groupBy("source", "target", "relation").agg(F.min(F.struct("seq", "weight")).alias("x"))
    new = first.join(edges.select("source", "target", "relation").distinct(), ["source", "target", "relation"], "left_anti")
    return new.select(F.col("x.seq").alias("seq"), "source", "target", "relation", F.col("x.weight").alias("weight"))


def append_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    return nodes.unionByName(new, allowMissingColumns=True)


def append_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.unionByName(new, allowMissingColumns=True)


def _observed(metric: Observation) -> int | None:
    """The number of rows observed; null if Spark found the plan to be empty and took the observation out with it."""
    try:
        return metric.get["n"]
    except Py4JJavaError:
        return None


def merge(nodes: DataFrame, edges: DataFrame, entities: DataFrame, relations: DataFrame, label: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all nodes, all edges, tally nodes_added, nodes_merged, edges_added).

    The tally is observed while the new rows are written: nothing is counted by running a plan again.
    """
    count = F.count(F.lit(1)).alias("n")
    came, fresh, linked = Observation(), Observation(), Observation()
    new = settled(merge_nodes(nodes, entities.observe(came, count), label)[0].observe(fresh, count), "nodes")
    every = append_nodes(nodes, new)
    added = settled(merge_edges(every, edges, relations).observe(linked, count), "new-edges")
    made, edges_made, seen = _observed(fresh) or 0, _observed(linked) or 0, _observed(came)
    seen = entities.count() if seen is None else seen  # all were merged, so Spark let go of the plan that saw them
    tally = nodes.sparkSession.createDataFrame([(made, seen - made, edges_made)], "nodes_added long, nodes_merged long, edges_added long")
    return every, append_edges(edges, added), tally


def status(nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: nodes, edges, chunks."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(nodes, "nodes").crossJoin(count(edges, "edges")).crossJoin(count(chunks, "chunks"))
