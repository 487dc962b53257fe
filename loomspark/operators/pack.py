"""Token-budgeted context: hits become spans of neighbouring chunks, grouped by document, within a budget.

Range building is a gaps-and-islands window per document. The budget is a left fold over documents in score
order, because whether a document fits depends on those before it; it runs as one ``aggregate`` over the
array of a query's documents, of which there are at most as many as hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

OVERHEAD = 24


def merge_ranges(hits: DataFrame, neighbors: int, doc: str = "doc_id", idx: str = "idx") -> DataFrame:
    """(doc, first, last): each hit's index with ``neighbors`` on both sides, ranges that touch as one."""
    spread = hits.select(doc, F.greatest(F.col(idx) - neighbors, F.lit(0)).alias("lo"), (F.col(idx) + neighbors).alias("hi")).distinct()
    before = Window.partitionBy(doc).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    marked = spread.withColumn("new", (F.coalesce(F.max("hi").over(before), F.lit(-2)) + 1 < F.col("lo")).cast("int"))
    island = F.sum("new").over(Window.partitionBy(doc).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("island", island).groupBy(doc, "island").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).drop("island")


def load_spans(ranges: DataFrame, chunks: DataFrame, q: str, doc: str = "doc_id") -> DataFrame:
    """(q, doc, first, last, tokens, text) of the chunks that exist in each range, in order."""
    met = ranges.join(chunks.select(doc, "idx", "text", "n_tokens"), doc).where(F.col("idx").between(F.col("first"), F.col("last")))
    own = F.array_sort(F.collect_list(F.struct(F.col("idx").alias("i"), F.col("text").alias("t"))))
    grouped = met.groupBy(q, doc, "first", "last").agg(own.alias("own"), F.sum("n_tokens").cast("long").alias("tokens"))
    return grouped.select(q, doc, F.element_at("own", 1)["i"].alias("first"), F.element_at("own", -1)["i"].alias("last"), "tokens", F.array_join(F.transform("own", lambda x: x["t"]), "\n\n").alias("text"))


def _taken(spans: str, budget: int, cap: int, overhead: int) -> str:
    """SQL: of a document's spans, those taken by index until one would pass the budget or the cap; the first always is."""
    step = (
        f"if(not s.open or (size(s.taken) > 0 and (s.tokens + x.tokens > {cap} or used + s.tokens + x.tokens > {budget})), "
        "named_struct('taken', s.taken, 'tokens', s.tokens, 'open', false), "
        "named_struct('taken', concat(s.taken, array(x)), 'tokens', s.tokens + x.tokens, 'open', true))"
    )
    start = f"named_struct('taken', cast(array() as array<struct<first:int,last:int,tokens:bigint,text:string>>), 'tokens', {overhead}L, 'open', true)"
    return f"aggregate({spans}, {start}, (s, x) -> {step})"


def assemble(hits: DataFrame, chunks: DataFrame, budget: int, neighbors: int = 1, overhead: int = OVERHEAD, query: str | None = None, doc: str = "doc_id") -> DataFrame:
    """One row per document of each query: doc, score, position, kept, tokens, spans.

    hits: doc_id, idx, score (and the ``query`` column, if given). Documents go by falling best score. A
    document whose spans exceed its cap (a third of the budget) is tried again without neighbours; one that
    does not fit in what is left is omitted, and later ones may still fit.
    """
    keys = [query] if query else []
    hits = hits if query else hits.withColumn("_q", F.lit(0))
    q = query or "_q"
    cap = max(budget // 3, overhead + 1)
    best = hits.groupBy(q, doc).agg(F.max("score").alias("score"))

    def spans(n: int, name: str) -> DataFrame:
        keyed = hits.withColumn("_k", F.struct(q, doc))
        ranges = merge_ranges(keyed, n, doc="_k").select(F.col(f"_k.{q}").alias(q), F.col(f"_k.{doc}").alias(doc), "first", "last")
        loaded = load_spans(ranges, chunks, q, doc)
        one = F.struct(F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"), F.col("tokens").cast("long").alias("tokens"), "text")
        return loaded.groupBy(q, doc).agg(F.array_sort(F.collect_list(one)).alias(name))

    docs = best.join(spans(neighbors, "wide"), [q, doc]).join(spans(0, "narrow"), [q, doc])
    listed = docs.groupBy(q).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), F.col(doc).alias("doc"), "wide", "narrow"))).alias("docs"))
    wide, narrow = (_taken(f"d.{n}", budget, cap, overhead).replace("used +", "a.used +") for n in ("wide", "narrow"))
    pick = f"transform(array({wide}), w -> if(w.tokens > {cap} and {neighbors} > 0, {narrow}, w))[0]"
    note = "named_struct('doc', d.doc, 'score', -d.order, 'kept', {kept}, 'tokens', p.tokens, 'spans', p.taken)"
    fits = f"a.used + p.tokens <= {budget}"
    step = f"transform(array({pick}), p -> named_struct('used', if({fits}, a.used + p.tokens, a.used), 'out', concat(a.out, array({note.format(kept=fits)}))))[0]"
    kind = f"array<struct<doc:{dict(hits.dtypes)[doc]},score:{dict(best.dtypes)['score']},kept:boolean,tokens:bigint,spans:array<struct<first:int,last:int,tokens:bigint,text:string>>>>"
    folded = listed.select(q, F.expr(f"aggregate(docs, named_struct('used', 0L, 'out', cast(array() as {kind})), (a, d) -> {step})").alias("f"))
    rows = folded.select(q, F.posexplode("f.out").alias("position", "d"))
    return rows.select(*keys, F.col("d.doc").alias(doc), F.col("d.score").alias("score"), "position", F.col("d.kept").alias("kept"), F.col("d.tokens").alias("tokens"), F.col("d.spans").alias("spans"))


def render_markdown(packed: DataFrame, title: str = "doc_id") -> DataFrame:
    """One text per kept document: a heading, and its spans with their chunk ranges."""
    spans = F.transform("spans", lambda s: F.concat(F.lit("[chunks "), s["first"].cast("string"), F.lit("-"), s["last"].cast("string"), F.lit("]\n"), s["text"]))
    return packed.where("kept").select("position", F.concat(F.lit("## "), F.col(title).cast("string"), F.lit("\n\n"), F.array_join(spans, "\n\n")).alias("markdown"))


def render_json(packed: DataFrame) -> DataFrame:
    return packed.select("position", F.to_json(F.struct(*packed.columns)).alias("json"))
