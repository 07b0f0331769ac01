"""Ranked search: postings, BM25, filters, ranking blends, snippets, cosine neighbours and rank fusion.

The corpus has a row per document: id, title, content, preview, agent, workspace, source_path, created_at.  A
query reads the postings of its own terms only (``term IN (...)`` reaches the scan of a stored index); statistics
are one row.  Order is total: ties end with the id."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import canon, text

K1, B = 1.2, 0.75
FIELDS = ("title", "content")
#: ranking -> (weight of BM25, weight of recency)
BLENDS = {"recent": (0.3, 0.7), "balanced": (0.5, 0.5), "relevance": (0.8, 0.2), "newest": (0.0, 1.0), "oldest": (0.0, -1.0)}


@dataclass(frozen=True)
class SearchQuery:
    text: str = ""
    agent: str | None = None
    workspace: str | None = None
    scope: tuple[str, ...] | None = None
    since: int | None = None
    until: int | None = None
    limit: int = 20
    offset: int = 0
    ranking: str = "recent"
    case_sensitive: bool = True
    rrf_k: int = 60
    filter_scores: bool = False  # filters are clauses of the query, whose scores add to BM25


def postings(docs: DataFrame) -> DataFrame:
    """field, term, id, tf, positions, length (of the field)."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), text.terms(F.coalesce(f, F.lit(""))).alias("terms")) for f in FIELDS])
    rows = docs.select("id", F.explode(fields).alias("f")).select("id", "f.field", F.size("f.terms").alias("length"), F.posexplode("f.terms").alias("pos", "term"))
    return rows.groupBy("field", "term", "id", "length").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))  # of one document


#: Terms whose places are worked out together, unless one document has more.
TERMS = 1 << 19


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different term of the lists (id, field, terms), by one stable sort of (row, term)."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False), dtype="i8")
        begin = 0
        while begin < len(ends):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + TERMS, "right")))
            part = batch.slice(begin, stop - begin)
            sizes = pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False)
            coded = part.column(2).flatten().dictionary_encode()
            codes, row = coded.indices.to_numpy().astype("i8"), np.repeat(np.arange(len(sizes)), sizes)
            key = row * len(coded.dictionary) + codes
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            own, edges = order[first], np.append(first, len(order)).astype("i4")
            places = pa.ListArray.from_arrays(pa.array(edges), pa.array((order - (np.cumsum(sizes) - sizes)[row[order]]).astype("i4")))
            at = pa.array(row[own])
            columns = [part.column(1).take(at), coded.dictionary.take(pa.array(codes[own])), part.column(0).take(at), pa.array(sizes[row[own]].astype("i4")), pa.array(np.diff(edges).astype("i8")), places]
            yield pa.RecordBatch.from_arrays(columns, names=["field", "term", "id", "length", "tf", "positions"])
            begin = stop


def all_postings(docs: DataFrame) -> DataFrame:
    """As ``postings``, where every term is wanted: a document's terms are in its row, so they are brought together there."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), text.terms(F.coalesce(f, F.lit(""))).alias("terms")) for f in FIELDS])
    rows = docs.select("id", F.explode(fields).alias("f")).select("id", "f.field", "f.terms").where(F.size("terms") > 0)
    return rows.mapInArrow(_placed, f"field string, term string, id {docs.schema['id'].dataType.simpleString()}, length int, tf long, positions array<int>")


def lengths(docs: DataFrame) -> DataFrame:
    """Per field: documents n, and the mean length avg."""
    sizes = [F.struct(F.lit(f).alias("field"), F.size(text.terms(F.coalesce(f, F.lit("")))).alias("length")) for f in FIELDS]
    return docs.select(F.explode(F.array(*sizes)).alias("f")).select("f.*").groupBy("field").agg(F.count("*").alias("n"), F.avg("length").alias("avg"))


def sizes_of(docs: DataFrame) -> DataFrame:
    """As ``lengths``, from the lengths that a stored index keeps beside its documents."""
    sums = docs.agg(F.count("*").alias("n"), *[F.sum(f"{f}_length").alias(f) for f in FIELDS])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), "n", (F.col(f) / F.col("n")).alias("avg")) for f in FIELDS])).alias("f")).select("f.*")


def parse_query(query: str, case_sensitive: bool = True) -> list[list[str]]:
    """Alternatives: one-term lists, and phrases for identifiers joined by underscores."""
    out: list[list[str]] = []
    for word in query.split():
        out.append([word if case_sensitive else word.lower()])
        parts = [p for p in word.split("_") if p]
        if len(parts) > 1 and all(p.isalnum() for p in parts):
            out.append([p.lower() for p in parts])
    return out


def bm25(index: DataFrame, sizes: DataFrame, alternatives: list[list[str]]) -> DataFrame:
    """(id, score) of documents with at least one alternative: Okapi BM25 summed over alternatives and fields."""
    wanted = sorted({t for a in alternatives for t in a})
    rows = index.where(F.col("term").isin(*wanted))
    hits = None
    for k, terms in enumerate(alternatives):
        own = rows.where(F.col("term") == terms[0]).select("field", "id", "length", "positions")
        for step, term in enumerate(terms[1:], 1):  # a phrase: the next term one place on
            nxt = rows.where(F.col("term") == term).select("field", "id", F.transform("positions", lambda p: p - step).alias("__next"))
            own = own.join(nxt, ["field", "id"]).select("field", "id", "length", F.array_intersect("positions", "__next").alias("positions"))
        own = own.where(F.size("positions") > 0).select(F.lit(k).alias("alt"), "field", "id", "length", F.size("positions").alias("tf"))
        hits = own if hits is None else hits.unionByName(own)
    df = hits.groupBy("alt", "field").agg(F.count("*").alias("df"))
    # a row per alternative and field, and a row per field: bounded by the query
    full = hits.join(F.broadcast(df), ["alt", "field"]).join(F.broadcast(sizes), "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg")))
    return full.groupBy("id").agg(F.sum(part).alias("score"))


def matches(docs: DataFrame, q: SearchQuery) -> DataFrame:
    """Filters of a query; all must hold."""
    if q.agent is not None:
        docs = docs.where(F.col("agent") == q.agent)
    if q.workspace is not None:
        docs = docs.where(F.col("workspace") == q.workspace)
    elif q.scope is not None:
        docs = docs.where(canon.in_scope("workspace", q.scope))
    created = F.coalesce("created_at", F.lit(0))
    if q.since is not None:
        docs = docs.where(created >= q.since)
    if q.until is not None:
        docs = docs.where(created <= q.until)
    return docs


def clause_scores(docs: DataFrame, q: SearchQuery) -> tuple[DataFrame, Column] | None:
    """What a query's filters add to a document's score: (one row with the documents' number and those of each term, the sum).

    A term of agent or workspace counts by how rare it is, as its field has one term; a range, of dates or of workspaces
    below a root, counts 1; of a scope all that holds counts.  None for a query without filters."""
    terms: list[Column] = []
    parts: list[Column] = []

    def term(where: Column) -> Column:
        terms.append(where)
        n, df = F.col("__n"), F.col(f"__df{len(terms) - 1}")
        return F.log(1 + (n - df + 0.5) / (df + 0.5))

    if q.agent is not None:
        parts.append(term(F.col("agent") == q.agent))
    if q.workspace is not None:
        parts.append(term(F.col("workspace") == q.workspace))
    elif q.scope is not None:
        unknown = F.coalesce("workspace", F.lit("")) == ""
        parts.append(F.when(unknown, term(unknown)).otherwise(0.0))
        for root in filter(None, (r.rstrip("/") for r in q.scope)):
            own = F.col("workspace") == root
            parts.append(F.when(own, term(own)).when(F.col("workspace").startswith(root + "/"), 1.0).otherwise(0.0))
    if q.since is not None or q.until is not None:
        parts.append(F.lit(1.0))
    if not parts:
        return None
    row = docs.agg(F.count("*").alias("__n"), *[F.count_if(w).alias(f"__df{k}") for k, w in enumerate(terms)])
    return row, sum(parts[1:], parts[0])


def recency(created: Column, as_of: int) -> Column:
    days = ((F.lit(as_of) - created) / 86_400_000).cast("long")
    return F.when(days <= 0, 1.0).when(days > 365, 0.0).otherwise(1 - days / 365.0)


def hits(docs: DataFrame, q: SearchQuery, index: DataFrame | None = None, sizes: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """All documents that match, with bm25; and whether they are to be sorted by date."""
    found = matches(docs, q)
    by_date = q.ranking in ("newest", "oldest") or not q.text.strip() and q.ranking in ("recent", "balanced")
    alternatives = parse_query(q.text, q.case_sensitive)
    more = clause_scores(docs, q) if q.filter_scores and not by_date else None
    if more is not None:  # by one row
        found = found.crossJoin(F.broadcast(more[0])).withColumn("__more", more[1])
    if not alternatives:
        base = F.lit(0.0 if by_date else 1.0) if more is None else F.col("__more")  # a query of filters only has their scores
        return found.withColumn("bm25", base).drop("__more", *([] if more is None else more[0].columns)), by_date
    scores = bm25(index if index is not None else postings(docs), sizes if sizes is not None else lengths(docs), alternatives)
    score = F.lit(0.0) if by_date else F.col("score") if more is None else F.col("score") + F.col("__more")
    return found.join(scores, "id").withColumn("bm25", score).drop("score", "__more", *([] if more is None else more[0].columns)), by_date


def search(docs: DataFrame, q: SearchQuery, as_of: int, index: DataFrame | None = None, sizes: DataFrame | None = None, mode: str = "window") -> DataFrame:
    """One page: id, score, created_at, agent, title, workspace, source_path, preview, snippet, rank.

    ``window`` blends the BM25 page only, as a page is cut out before its blended order is made; ``global`` blends
    all hits first."""
    cols = [c for c in ("agent", "title", "workspace", "source_path", "preview") if c in docs.columns]
    # of a stored index, what is shown is read for the page alone
    found, by_date = hits(docs.select("id", *[c for c in ("agent", "workspace") if c in docs.columns], "created_at") if index is not None else docs, q, index, sizes)
    created = F.coalesce("created_at", F.lit(0))
    words, recent = BLENDS[q.ranking]
    found = found.withColumn("score", F.col("bm25") * words + recency(created, as_of) * recent)
    keys = {"date": created.asc() if q.ranking == "oldest" else created.desc(), "bm25": F.desc("bm25"), "score": F.desc("score")}
    first = keys["date"] if by_date else keys["score"] if mode == "global" else keys["bm25"]
    page = found.orderBy(first, "id").limit(q.limit + q.offset)
    if q.offset:
        page = page.orderBy(first, "id").offset(q.offset)
    if index is not None:
        page = docs.select("id", *cols).join(F.broadcast(page.select("id", "score", "created_at")), "id")
    rank = F.row_number().over(W.orderBy(keys["date"] if by_date else keys["score"], "id"))  # of one page
    return page.select("id", "score", created.alias("created_at"), *cols, text.snippet("preview", q.text).alias("snippet"), rank.alias("rank"))


def count(docs: DataFrame, q: SearchQuery, index: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    return hits(docs, q, index, sizes)[0].agg(F.count("*").alias("total_hits"))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for vectors of different length or without length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def nearest(vectors: DataFrame, query: list[float], limit: int = 50, ident: str = "id", column: str = "embedding") -> DataFrame:
    """(id, similarity) of the most similar vectors; each task keeps ``limit`` rows."""
    at = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(ident).alias("id"), cosine(F.col(column), at).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(limit)


def fuse(keyword: DataFrame, semantic: DataFrame, k: int = 60, limit: int = 20, keep_semantic_only: bool = False) -> DataFrame:
    """Reciprocal rank fusion of two ranked pages (id, rank): the limit is taken before hits without a keyword hit go."""
    score = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    both = keyword.select("id", F.col("rank").alias("kr")).join(semantic.select("id", F.col("rank").alias("sr")), "id", "full_outer")
    page = both.select("id", "kr", (score("kr") + score("sr")).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    return page.select("id", "score") if keep_semantic_only else page.where("kr is not null").select("id", "score")


def with_rank(rows: DataFrame, *order: Column) -> DataFrame:
    """1-based ranks of a page."""
    return rows.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def hybrid(docs: DataFrame, vectors: DataFrame, vector: list[float], q: SearchQuery, as_of: int, index: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Keyword page and the 50 nearest vectors, of which those in scope, fused."""
    page = search(docs, q, as_of, index, sizes)
    near = nearest(vectors, vector)
    if q.scope is not None:
        near = near.join(docs.where(canon.in_scope("workspace", q.scope)).select("id"), "id", "left_semi")
    return fuse(page, with_rank(near, F.desc("similarity"), F.col("id")), q.rrf_k, q.limit)
