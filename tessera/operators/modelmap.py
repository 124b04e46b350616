"""Mapping of a foreign graph: name and overlap candidates, core overlap, co-occurrence as a prior, whole models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.facets import norm_key_unicode
from tessera.operators import encode, retrieve
from tessera.operators.numbering import number_rows
from tessera.plans.stage import materialize

#: Members that are in so many sets that they tell nothing.
UBIQUITOUS = [f"cpd000{n:02d}" for n in (1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13, 18, 67)]
#: What an equal key adds, and the weight of the neighbours' vote.
EXACT, NETWORK = 1.0, 0.5
#: Weights of the name, the set, an equal set within it, and the prior; members of the pool a rerank has.
NAME, SET, EQUAL, PRIOR, POOL = 1.0, 1.5, 0.5, 0.30, 20


def overlap_candidates(queries: DataFrame, targets: DataFrame, least: int = 2) -> DataFrame:
    """(query_id, target_id, shared) of sets that share ``least`` members, or all of the query's."""
    size = queries.groupBy("query_id").agg(F.count("*").alias("n"))
    shared = queries.join(targets, "member").groupBy("query_id", "target_id").agg(F.count("*").alias("shared"))
    return shared.join(size, "query_id").where((F.col("shared") >= least) | (F.col("shared") == F.col("n"))).select("query_id", "target_id", "shared")


def core_jaccard(cands: DataFrame, queries: DataFrame, targets: DataFrame, ubiquitous: DataFrame) -> DataFrame:
    """Adds core, the Jaccard similarity of both sets without members that are everywhere, and exact (sets equal)."""
    q, t = (d.join(ubiquitous, "member", "left_anti") for d in (queries, targets))
    nq, nt = q.groupBy("query_id").agg(F.count("*").alias("nq")), t.groupBy("target_id").agg(F.count("*").alias("nt"))
    both = cands.join(q, "query_id").join(t, ["target_id", "member"]).groupBy("query_id", "target_id").agg(F.count("*").alias("both"))
    out = cands.join(both, ["query_id", "target_id"], "left").join(nq, "query_id", "left").join(nt, "target_id", "left")
    n = [F.coalesce(c, F.lit(0)) for c in ("both", "nq", "nt")]
    union = n[1] + n[2] - n[0]
    return out.select("query_id", "target_id", "shared", (n[0] / F.greatest(union, F.lit(1))).alias("core"), ((n[0] == n[1]) & (n[0] == n[2]) & (n[0] > 0)).cast("int").alias("exact"))


def canon_prior(status: Column, obsolete: Column) -> Column:
    s = F.coalesce(status, F.lit(""))
    return F.when(obsolete, -1.0).when(s.startswith("OK"), 1.0).when(s.contains("CPDFORMERROR"), -0.3).when(s.startswith("MI") | s.startswith("CI"), 0.0).otherwise(0.3)


def cooccurrence(bridge: DataFrame, ubiquitous: DataFrame) -> DataFrame:
    """Distinct (member, other) pairs that stand in one set, members that are everywhere left out."""
    core = bridge.join(ubiquitous, "member", "left_anti")
    a, b = core.alias("a"), core.alias("b")
    return a.join(b, (F.col("a.target_id") == F.col("b.target_id")) & (F.col("a.member") != F.col("b.member"))).select(F.col("a.member").alias("member"), F.col("b.member").alias("other")).distinct()


def synonym_index(entities: DataFrame, include_obsolete: bool = False) -> DataFrame:
    """(item_id, key, text): the first text of each key of each entity. ``entities``: item_id, synonyms, is_obsolete."""
    kept = entities if include_obsolete else entities.where("NOT coalesce(is_obsolete, false)")
    each = kept.select("item_id", F.posexplode("synonyms").alias("at", "text"))
    keyed = each.withColumn("key", norm_key_unicode("text")).where("key <> ''")
    return keyed.groupBy("item_id", "key").agg(F.min_by("text", "at").alias("text"))


def exact_matches(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, item_id) of equal keys; ``queries``: query_id, name."""
    return queries.withColumn("key", norm_key_unicode("name")).where("key <> ''").join(index.select("item_id", "key"), "key").select("query_id", "item_id").distinct()


def name_similarities(queries: DataFrame, index: DataFrame, encoder: str | Callable, depth: int) -> DataFrame:
    """(query_id, item_id, sim): the best of an entity's texts among the ``depth`` nearest texts of each query."""
    q = encode.encode(number_rows(queries.select("query_id", "name"), ["query_id"], "q"), {"name": "v"}, encoder)
    t = encode.encode(number_rows(index.select("item_id", "text"), ["item_id", "text"], "t"), {"text": "v"}, encoder)
    q, t = materialize(q, "named-queries"), materialize(t, "named-texts")
    near = retrieve.top_k(q.select("q", "v"), t.select("t", "v"), depth, "q", "v", "t", "v").select(F.col("query_id").alias("q"), F.col("item_id").alias("t"), "sim")
    return retrieve.max_pool(near.join(q.select("q", "query_id"), "q").join(t.select("t", "item_id"), "t"), "item_id")


def _ranked(scored: DataFrame, top_k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def compound_scores(sims: DataFrame, exact: DataFrame, entities: DataFrame, top_k: int) -> DataFrame:
    """(query_id, item_id, emb, exact, score, rank): similarity, a bonus for an equal key, a little for core members and
    against obsolete ones. Candidates known by their key alone have similarity 0."""
    both = sims.withColumnRenamed("sim", "emb").join(exact.withColumn("exact", F.lit(1)), ["query_id", "item_id"], "full_outer")
    both = both.select("query_id", "item_id", F.coalesce("emb", F.lit(0.0)).alias("emb"), F.coalesce("exact", F.lit(0)).alias("exact"))
    marks = entities.select("item_id", F.coalesce("is_core", F.lit(False)).cast("int").alias("core"), F.coalesce("is_obsolete", F.lit(False)).cast("int").alias("old"))
    score = F.col("emb") + EXACT * F.col("exact") + 0.001 * F.col("core") - 0.002 * F.col("old")
    return _ranked(both.join(marks, "item_id").withColumn("score", score), top_k).select("query_id", "item_id", "emb", "exact", "score", "rank")


def co_members(members: DataFrame) -> DataFrame:
    """Distinct (query_id, neighbour) that stand in one set; ``members``: set_id, query_id."""
    a, b = members.alias("a"), members.alias("b")
    return a.join(b, (F.col("a.set_id") == F.col("b.set_id")) & (F.col("a.query_id") != F.col("b.query_id"))).select("a.query_id", F.col("b.query_id").alias("neighbour")).distinct()


def neighbour_votes(members: DataFrame, first: DataFrame) -> DataFrame:
    """Distinct (query_id, other): items that are first of another query which stands in one set with it.

    ``members``: set_id, query_id, distinct; ``first``: query_id, other, one row a query. No pairs of queries are listed:
    items are numbered, each set is summed up as words of 64 bits of its items, and those of a query's sets are put
    together before they are shuffled. An item that a query alone brings into a set does not count for itself.
    """
    ids = number_rows(first.select("other").distinct(), ["other"], "no")
    own = first.join(ids, "other").select("query_id", F.expr("(no - 1) div 64").alias("word"), F.expr("shiftleft(1L, CAST((no - 1) % 64 AS INT))").alias("bit"))
    held = members.select("set_id", "query_id").join(own, "query_id", "left").repartition("set_id")
    items = held.where("bit IS NOT NULL").groupBy("set_id", "word", "bit").agg((F.min("query_id") == F.max("query_id")).alias("once"))
    sets = items.groupBy("set_id", F.col("word").alias("at")).agg(F.bit_or("bit").alias("bits"), F.bit_or(F.when(F.col("once"), F.col("bit")).otherwise(F.lit(0).cast("long"))).alias("once"))
    alone = (F.col("at") == F.col("word")) & (F.col("once").bitwiseAND(F.col("bit")) != 0)
    bits = F.when(alone, F.col("bits").bitwiseAND(F.bitwise_not("bit"))).otherwise(F.col("bits"))
    seen = held.join(sets, "set_id").select("query_id", "at", bits.alias("bits")).groupBy("query_id", "at").agg(F.bit_or("bits").alias("bits"))
    each = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col("bits"), i) == 1)
    return seen.select("query_id", "at", F.explode(each).alias("i")).withColumn("no", F.col("at") * 64 + F.col("i") + 1).join(ids, "no").select("query_id", "other")


def network_rerank(ranked: DataFrame, members: DataFrame, cooc: DataFrame, ubiquitous: DataFrame, top_k: int, weight: float = NETWORK) -> DataFrame:
    """Adds ``net``, the share of the neighbours' first ranks that a candidate stands with somewhere, and ranks anew.

    ``members``: set_id, query_id, distinct; neighbours stand in one set. ``cooc``: member, other. A query whose neighbours
    have no first rank that tells anything has net 0.
    """
    first = ranked.where("rank = 1").select("query_id", F.col("item_id").alias("member")).join(ubiquitous, "member", "left_anti")
    votes = materialize(neighbour_votes(members, first.withColumnRenamed("member", "other")), "votes")
    n = votes.groupBy("query_id").agg(F.count("*").alias("n"))
    with_ = ranked.select("query_id", "item_id").join(votes, "query_id").join(cooc.select(F.col("member").alias("item_id"), "other"), ["item_id", "other"]).groupBy("query_id", "item_id").agg(F.count("*").alias("k"))
    out = ranked.drop("rank").join(n, "query_id", "left").join(with_, ["query_id", "item_id"], "left")
    net = F.coalesce(F.coalesce("k", F.lit(0)) / F.col("n"), F.lit(0.0))
    return _ranked(out.withColumn("net", net).withColumn("score", F.col("score") + weight * net).drop("n", "k"), top_k)


def reaction_scores(sims: DataFrame, queries: DataFrame, targets: DataFrame, status: DataFrame, ubiquitous: DataFrame, top_k: int, canon: bool = True) -> DataFrame:
    """(query_id, item_id, name, set_jac, exact_set, score, rank) over the union of name and overlap candidates.

    ``sims``: query_id, item_id, sim; ``queries``: query_id, member; ``targets``: target_id, member; ``status``: item_id,
    status, is_obsolete. A candidate of one kind alone counts 0 for the other.
    """
    shared = overlap_candidates(queries, targets).select("query_id", "target_id")
    every = sims.select("query_id", F.col("item_id").alias("target_id")).union(shared).distinct()
    sets = core_jaccard(every.withColumn("shared", F.lit(0)), queries, targets, ubiquitous)
    out = sets.withColumnRenamed("target_id", "item_id").join(sims, ["query_id", "item_id"], "left").join(status.select("item_id", "status", "is_obsolete"), "item_id", "left")
    name = F.coalesce("sim", F.lit(0.0))
    score = NAME * name + SET * (F.col("core") + EQUAL * F.col("exact"))
    if canon:
        score = score + PRIOR * canon_prior(F.col("status"), F.coalesce("is_obsolete", F.lit(False)))
    out = out.select("query_id", "item_id", name.alias("name"), F.col("core").alias("set_jac"), F.col("exact").alias("exact_set"), score.alias("score"))
    return _ranked(out, top_k)


def map_model(model: dict[str, DataFrame], compounds: DataFrame, reactions: DataFrame, encoder: str | Callable = "hashed", top_k: int = 100, network: bool = True) -> dict[str, DataFrame]:
    """Ranked targets of every metabolite and reaction of a model.

    ``model``: metabolites (id, name, compartment), reactions (id, name), members (reaction_id, metabolite_id).
    ``compounds``, ``reactions``: tables of the catalogue readers. Returns compounds and reactions: query_id, item_id,
    rank, score and signals.
    """
    spark = compounds.sparkSession
    everywhere = F.broadcast(spark.createDataFrame([(m,) for m in UBIQUITOUS], "member string"))
    c = compounds.select(F.col("id").alias("item_id"), "synonyms", "is_core", "is_obsolete")
    names = model["metabolites"].select(F.col("id").alias("query_id"), F.trim(F.coalesce("name", F.lit(""))).alias("name"))
    index = materialize(synonym_index(c), "compound-names")
    sims = name_similarities(names, index, encoder, max(200, 4 * top_k))
    ranked = compound_scores(sims, exact_matches(names, index), c, max(top_k, POOL))
    live = reactions.where("NOT coalesce(is_obsolete, false)")
    bridge = materialize(live.select(F.col("id").alias("target_id"), F.explode("compound_ids").alias("member")).distinct(), "reaction-members")
    held = model["members"].select(F.col("reaction_id").alias("set_id"), F.col("metabolite_id").alias("query_id")).distinct()
    if network:
        ranked = network_rerank(materialize(ranked, "compound-ranks"), held, cooccurrence(bridge, everywhere), everywhere, top_k)
    else:
        ranked = ranked.where(F.col("rank") <= top_k).withColumn("net", F.lit(0.0))
    ranked = materialize(ranked, "mapped-compounds")
    r = live.select(F.col("id").alias("item_id"), F.when(F.size("synonyms") > 0, F.col("synonyms")).otherwise(F.array("name")).alias("synonyms"), "status", "is_obsolete")
    titles = model["reactions"].select(F.col("id").alias("query_id"), F.trim(F.coalesce("name", F.lit(""))).alias("name"))
    found = name_similarities(titles, materialize(synonym_index(r), "reaction-names"), encoder, max(100, 3 * top_k))
    of = ranked.where("rank = 1").select("query_id", F.col("item_id").alias("member"))
    mapped = held.join(of, "query_id").select(F.col("set_id").alias("query_id"), "member").distinct()
    return {"compounds": ranked, "reactions": reaction_scores(found, mapped, bridge, r, everywhere, top_k)}


def model_tables(model: dict[str, DataFrame], mapped: dict[str, DataFrame], compounds: DataFrame, reactions: DataFrame, run: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The tables of a mapped model: targets, queries and predictions of compounds and reactions, run and performance."""
    spark = compounds.sparkSession
    own = F.lit("ModelSEED").alias("source_db")

    def queries(kind: str, rows: DataFrame, *more: Column) -> DataFrame:
        best = mapped[kind].groupBy("query_id").agg(F.count("*").alias("n_candidates"), F.min_by("item_id", "rank").alias("top1_id"), F.min_by("score", "rank").alias("top1_score"))
        return rows.join(best, F.col("id") == F.col("query_id"), "left").select(F.col("id").alias("local_id"), *more, F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), "top1_id", "top1_score")

    wanted = {k: mapped[k].select(F.col("item_id").alias("id")).distinct() for k in mapped}
    ct, rt = compounds.join(wanted["compounds"], "id", "left_semi"), reactions.join(wanted["reactions"], "id", "left_semi")
    none, no = F.lit(None).cast("string"), F.lit(0)
    return {
        "run_metadata": spark.createDataFrame(sorted((str(k), str(v)) for k, v in (run or {}).items()), "key string, value string"),
        "performance": spark.createDataFrame([], "phase string, n_queries int, wall_seconds double, queries_per_sec double, ms_per_query double, peak_rss_mb double, peak_gpu_mb double, notes string"),
        "compound_targets": ct.select(F.col("id").alias("cpd_id"), "name", "formula", "charge", F.lit(None).cast("double").alias("mass"), "inchikey", F.coalesce("is_core", F.lit(False)).cast("int").alias("is_core"), own),
        "compound_queries": queries("compounds", model["metabolites"], F.trim(F.coalesce("name", F.lit(""))).alias("name"), F.col("compartment"), none.alias("gold_ids")).withColumns({"top1_correct": no, "top1_chem_correct": no}),
        "compound_predictions": mapped["compounds"].select(F.col("query_id").alias("local_id"), "rank", F.col("item_id").alias("modelseed_cpd_id"), "score", F.col("emb").alias("emb_sim"), F.col("exact").alias("exact_match"), F.col("net").alias("network_score"), no.alias("is_gold")),
        "reaction_targets": rt.select(F.col("id").alias("rxn_id"), "name", F.nullif(F.array_join("ecs", ";"), F.lit("")).alias("ec"), none.alias("equation"), none.alias("definition"), F.nullif(F.array_join("pathways", ";"), F.lit("")).alias("pathways"), "status", F.coalesce("is_obsolete", F.lit(False)).cast("int").alias("is_obsolete"), own),
        "reaction_queries": queries("reactions", model["reactions"], none.alias("name"), none.alias("gold_id"), F.lit(None).cast("int").alias("n_metabolites"), no.alias("is_exchange")).withColumns({"top1_correct": no, "top1_equiv": no}),
        "reaction_predictions": mapped["reactions"].select(F.col("query_id").alias("local_id"), "rank", F.col("item_id").alias("modelseed_rxn_id"), "score", F.col("name").alias("name_sim"), F.col("set_jac").alias("set_jaccard"), "exact_set", no.alias("is_gold")),
    }


#: Keys of those tables, for a store that replaces rows.
MODEL_KEYS = {
    "run_metadata": ["key"],
    "performance": ["phase"],
    "compound_targets": ["cpd_id"],
    "compound_queries": ["local_id"],
    "compound_predictions": ["local_id", "rank"],
    "reaction_targets": ["rxn_id"],
    "reaction_queries": ["local_id"],
    "reaction_predictions": ["local_id", "rank"],
}


def top_n(t: dict[str, DataFrame], kind: str) -> DataFrame:
    """Queries with their predictions and what is known of the targets; kind: compound or reaction."""
    key = {"compound": "cpd", "reaction": "rxn"}[kind]
    q = t[f"{kind}_queries"].withColumnRenamed("name", "query_name").drop("n_candidates", "top1_id", "top1_score", *(c for c in t[f"{kind}_queries"].columns if c.startswith("top1")))
    named = t[f"{kind}_targets"].withColumnRenamed("name", f"{key}_name").drop("source_db")
    return q.join(t[f"{kind}_predictions"], "local_id").join(named, F.col(f"modelseed_{key}_id") == F.col(f"{key}_id")).drop(f"{key}_id")
