"""Authors, organizations and tags: new names with ids, and the links from documents to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.operators.hot_join import join_lookup
from docsift.operators.numbering import number_rows
from docsift.session import Workspace

# Kind of entity and the table it is stored in.
ENTITY_TABLES = {"author": "authors", "organization": "organizations", "tag": "tags"}


@dataclass(frozen=True)
class Entities:
    new_names: DataFrame  # kind, name, entity_id, first_id (of the document that brings it)
    known_names: DataFrame  # kind, name, entity_id: stored names that are mentioned
    names: DataFrame  # kind, name, entity_id: all names that are mentioned
    links: DataFrame  # id (of the document), kind, position, entity_id


def entity_mentions(kept: DataFrame) -> DataFrame:
    """(id, kind, position, name) from kept records with id, author_name, organization_name, tags."""

    def mention(kind: str, position, name):
        return F.struct(F.lit(kind).alias("kind"), position.cast("int").alias("position"), name.alias("name"))

    mentions = F.concat(
        F.array(mention("author", F.lit(0), F.col("author_name"))),
        F.array(mention("organization", F.lit(0), F.col("organization_name"))),
        F.transform("tags", lambda tag, position: mention("tag", position, tag)),
    )
    return kept.select("id", F.inline(mentions)).where("name IS NOT NULL")


def known_entities(authors: DataFrame, organizations: DataFrame, tags: DataFrame) -> DataFrame:
    """The three stored tables as one: kind, name, entity_id."""
    parts = [
        table.select(F.lit(kind).alias("kind"), "name", F.col("id").alias("entity_id"))
        for kind, table in zip(ENTITY_TABLES, (authors, organizations, tags), strict=True)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def mentioned_names(kept: DataFrame, workspace: Workspace) -> tuple[DataFrame, DataFrame]:
    """Two written tables: all mentions, and (kind, name, first_id, first_position) of each name.

    Names are counted with map-side combination, so a name on a third of all documents is no burden.
    """
    mentions = workspace.write(entity_mentions(kept), "mentions")
    # A name occurs at most once per kind in a document, so the earliest document decides the position too.
    names = mentions.groupBy("kind", "name").agg(
        F.min("id").alias("first_id"), F.min_by("position", "id").alias("first_position")
    )
    return mentions, workspace.write(names, "names")


def resolve_entities(
    mentions: DataFrame, names: DataFrame, known: DataFrame, last_ids: dict[str, int], workspace: Workspace
) -> Entities:
    """Give each new name the next id of its kind, in order of first appearance, and link every mention.

    ``known`` has the stored names among those mentioned (kind, name, entity_id), ``last_ids`` the last id of each kind.
    """
    known = workspace.write(known, "known-names")
    fresh = names.join(known.select("kind", "name"), ["kind", "name"], "left_anti")
    ordered = number_rows(fresh, ["kind", "first_id", "first_position"], "ordinal", workspace)
    # One row per kind, three in all.
    starts = ordered.groupBy("kind").agg(F.min("ordinal").alias("start"))
    last_id = F.create_map(*[F.lit(x) for kind in ENTITY_TABLES for x in (kind, last_ids.get(kind, 0))])
    new_names = ordered.join(F.broadcast(starts), "kind").select(
        "kind", "name", (last_id[F.col("kind")] + F.col("ordinal") - F.col("start") + 1).alias("entity_id"), "first_id"
    )
    new_names = workspace.write(new_names, "new-names")
    lookup = workspace.write(known.unionByName(new_names.drop("first_id")), "name-ids", measure=True)
    links = join_lookup(mentions, lookup, ["kind", "name"], "inner", workspace)
    links = workspace.write(links.select("id", "kind", "position", "entity_id"), "links")
    return Entities(new_names, known, lookup, links)


def foreign_keys(links: DataFrame) -> DataFrame:
    """(id, author_id, organization_id) of the documents that have either."""
    return (
        links.where("kind <> 'tag'")
        .groupBy("id")
        .agg(
            F.max(F.when(F.col("kind") == "author", F.col("entity_id"))).alias("author_id"),
            F.max(F.when(F.col("kind") == "organization", F.col("entity_id"))).alias("organization_id"),
        )
    )


def tag_links(links: DataFrame) -> DataFrame:
    return links.where("kind = 'tag'").select(
        F.col("id").alias("document_id"), F.col("entity_id").alias("tag_id"), "position"
    )
