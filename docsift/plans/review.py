"""Reading stored documents: filtered, searchable, paged lists and single documents with their entities."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.operators.entities import known_entities
from docsift.operators.hot_join import join_lookup
from docsift.session import Workspace
from docsift.sources.store import DocumentStore

ITEM_COLUMNS = (
    "id", "external_id", "title", "abstract", "published_at", "status", "document_type", "completeness_score",
    "quality_tier",
)
DETAIL_COLUMNS = (
    *ITEM_COLUMNS, "body", "updated_at", "language", "region", "source_name", "url", "doi", "open_access",
    "peer_reviewed", "citation_count", "page_count", "word_count", "author_name", "organization_name", "tags",
)
SORTS = ("id", "score")
MAX_PAGE_SIZE = 100


@dataclass(frozen=True)
class DocumentPage:
    items: DataFrame
    total: int
    page: int
    page_size: int


def filter_documents(
    store: DocumentStore,
    *,
    date_from: date | None = None,
    date_to: date | None = None,
    tag: str | None = None,
    organization: str | None = None,
    status: str | None = None,
    q: str | None = None,
    blocks: set[int] | None = None,
) -> DataFrame:
    """Stored documents that meet all given conditions.

    ``q`` is a literal, case-insensitive substring of title or body. Empty arguments set no condition. With ``blocks``,
    only documents whose ids lie in these blocks are read.
    """
    store = store.snapshot()
    read = store.table if blocks is None else partial(store.blocks, wanted=blocks)
    documents = read("documents")
    if date_from is not None:
        documents = documents.where(F.col("published_at") >= F.lit(date_from))
    if date_to is not None:
        documents = documents.where(F.col("published_at") <= F.lit(date_to))
    if status:
        documents = documents.where(F.col("status") == status.strip().casefold())
    if q:
        wanted = F.lower(F.lit(q))
        documents = documents.where(
            F.contains(F.lower("title"), wanted) | F.contains(F.lower("body"), wanted)
        )
    # Names are unique, so each of these finds at most one id, which is all that is broadcast.
    if tag:
        tags = store.table("tags").where(F.col("name") == tag.strip().casefold()).select(F.col("id").alias("tag_id"))
        tagged = read("document_tags").join(F.broadcast(tags), "tag_id", "left_semi")
        documents = documents.join(tagged.select(F.col("document_id").alias("id")), "id", "left_semi")
    if organization:
        named = store.table("organizations").where(F.col("name") == organization.strip())
        organizations = named.select(F.col("id").alias("organization_id"))
        documents = documents.join(F.broadcast(organizations), "organization_id", "left_semi")
    return documents


def check_list_arguments(page: int, page_size: int, date_from: date | None, date_to: date | None, sort: str) -> None:
    if page < 1:
        raise ValueError("page must be at least 1")
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page_size must be from 1 to {MAX_PAGE_SIZE}")
    if date_from and date_to and date_from > date_to:
        raise ValueError("the range of dates ends before it begins")
    if sort not in SORTS:
        raise ValueError("sort must be id or score")


def _rank(sort: str, score: str):
    """What a list is sorted by before the id: at most as many values as there are scores."""
    return (-F.col(score) if sort == "score" else F.lit(0)).alias("rank")


def _counts(store: DocumentStore, sort: str, documents: DataFrame | None, workspace: Workspace) -> DataFrame:
    """(rank, block, documents): how many documents of the list lie in each block of ids.

    For the list of all documents these are sums that the imports have left; others are read, once.
    """
    if documents is None:
        return store.table("score_blocks").select(_rank(sort, "score"), "block", "documents")
    block = store.block_of(F.col("id")).alias("block")
    counts = documents.groupBy(_rank(sort, "completeness_score"), block).agg(F.count("*").alias("documents"))
    return workspace.write(counts, "counts")


def _cells(counts: DataFrame, ranks: dict[int, int], first: int, end: int) -> DataFrame:
    """(rank, block, before) of the blocks that hold the places ``first`` to ``end - 1``; each has one of them at least."""
    before, starts = 0, []
    for rank, documents in sorted(ranks.items()):
        if before < end and before + documents > first:
            starts.append((rank, before))
        before += documents
    starting = counts.sparkSession.createDataFrame(starts, "rank int, start bigint")
    chosen = counts.join(F.broadcast(starting), "rank").groupBy("rank", "start", "block").agg(
        F.sum("documents").alias("documents")
    )
    so_far = Window.partitionBy("rank").orderBy("block")
    placed = chosen.withColumn("after", F.col("start") + F.sum("documents").over(so_far))
    placed = placed.withColumn("before", F.col("after") - F.col("documents"))
    return placed.where((F.col("before") < end) & (F.col("after") > first)).select("rank", "block", "before")


def page_of(
    store: DocumentStore, found: Callable[[set[int] | None], DataFrame], page: int, page_size: int, sort: str,
    everything: bool = False,
) -> DocumentPage:
    """A page of the documents that ``found`` gives for some blocks of ids, or for all (None), and how many there are.

    Where the page lies is told by counts by score and block of ids; then only the blocks with the page's documents are
    read, however far back the page is. What is collected are the counts by score and a page of ids. ``store`` is a
    snapshot; ``everything`` says that the list holds all its documents.
    """
    first, end = (page - 1) * page_size, page * page_size
    with Workspace(store.spark) as workspace:
        counts = _counts(store, sort, None if everything else found(None), workspace)
        by_rank = counts.groupBy("rank").agg(F.sum("documents").alias("documents"))
        ranks = {row["rank"]: row["documents"] for row in by_rank.collect()}
        total = sum(ranks.values())
        cells = _cells(counts, ranks, first, end).collect() if first < total else []
    ids = []
    if cells:
        within = Window.partitionBy("rank", "block").orderBy("id")
        near = found({cell["block"] for cell in cells}).select(
            "id", _rank(sort, "completeness_score"), store.block_of(F.col("id")).alias("block")
        )
        # At most a page of them.
        held = F.broadcast(store.spark.createDataFrame(cells, "rank int, block bigint, before bigint"))
        place = F.col("before") + F.row_number().over(within) - 1
        placed = near.join(held, ["rank", "block"]).withColumn("place", place)
        ids = [row["id"] for row in placed.where(F.col("place").between(first, end - 1)).collect()]
    items = store.blocks("documents", {number // store.block_ids for number in ids}).where(F.col("id").isin(ids))
    order = [F.col("completeness_score").desc(), F.col("id")] if sort == "score" else [F.col("id")]
    return DocumentPage(items.select(*ITEM_COLUMNS).orderBy(*order), total, page, page_size)


def list_documents(
    store: DocumentStore, *, page: int = 1, page_size: int = 20, sort: str = "id", **conditions
) -> DocumentPage:
    """A page of the documents that meet the conditions of filter_documents, and how many meet them."""
    check_list_arguments(page, page_size, conditions.get("date_from"), conditions.get("date_to"), sort)
    store = store.snapshot()

    def found(blocks: set[int] | None) -> DataFrame:
        return filter_documents(store, **conditions, blocks=blocks)

    return page_of(store, found, page, page_size, sort, everything=not any(conditions.values()))


def _references(documents: DataFrame, links: DataFrame) -> DataFrame:
    """(id, kind, position, entity_id): all that the documents refer to, without their texts."""

    def reference(kind: str):
        return F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("position"), F.col(f"{kind}_id").alias("entity_id"))

    direct = documents.select("id", F.inline(F.array(reference("author"), reference("organization"))))
    tagged = links.select(
        F.col("document_id").alias("id"), F.lit("tag").alias("kind"), "position", F.col("tag_id").alias("entity_id")
    )
    return direct.where("entity_id IS NOT NULL").unionByName(tagged)


def _with_names(documents: DataFrame, named: DataFrame) -> DataFrame:
    """Documents with the names of (id, kind, position, name) gathered per document."""
    tag = F.when(F.col("kind") == "tag", F.struct("position", "name"))
    gathered = named.groupBy("id").agg(
        F.max(F.when(F.col("kind") == "author", F.col("name"))).alias("author_name"),
        F.max(F.when(F.col("kind") == "organization", F.col("name"))).alias("organization_name"),
        F.array_sort(F.collect_list(tag)).alias("placed"),
    )
    names = gathered.select("id", "author_name", "organization_name", F.col("placed.name").alias("tags"))
    return (
        documents.join(names, "id", "left")
        .withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
        .select(*DETAIL_COLUMNS)
    )


def document_details(store: DocumentStore, workspace: Workspace | None = None) -> DataFrame:
    """All columns of all documents with author and organization names and the tags in their given order.

    Names are looked up on narrow rows, safely for names that many documents share, and gathered by document;
    the documents' texts are joined once, by id.
    """
    tables = store.tables()
    known = known_entities(tables["authors"], tables["organizations"], tables["tags"])
    references = _references(tables["documents"], tables["document_tags"])
    named = join_lookup(references, known, ["kind", "entity_id"], "inner", workspace or Workspace(store.spark))
    return _with_names(tables["documents"], named)


def get_document(store: DocumentStore, document_id: int) -> DataFrame:
    """The detail of one document; no row if there is none. Of documents and links one block of ids is read."""
    store = store.snapshot()
    block = {document_id // store.block_ids}
    document = store.blocks("documents", block).where(F.col("id") == document_id)
    links = store.blocks("document_tags", block).where(F.col("document_id") == document_id)
    known = known_entities(store.table("authors"), store.table("organizations"), store.table("tags"))
    # What one document refers to is as small as the document's own tag list.
    named = known.join(F.broadcast(_references(document, links)), ["kind", "entity_id"])
    return _with_names(document, named)
