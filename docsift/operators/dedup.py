"""First-come duplicate resolution over two keys.

A record is dropped when its DOI or its fingerprint belongs to a stored record or to an earlier kept one; a
dropped record claims no key. So whether a record is kept depends on whether the holders of its keys were.

Each record gets a token: its place in the import order times two, plus one if it has both keys. Stored
records get tokens below all new ones. A record that is the first on every key it has is kept and claims
those keys; records of which a key is claimed are dropped; those whose keys are all still open go to the
next round. Few are left after the first round.

From the second round on, chains are settled as a whole. A record that waits for exactly one earlier record is
kept if and only if that one is dropped. So it points to it with one flip, pointers are doubled until they
reach a record that does not wait for a single one, and the number of flips decides. A chain of any length takes one
round, with steps that grow with the logarithm of its length. Records that wait for several others stay for later
rounds; only nests of such records add rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.operators.hot_join import join_lookup
from docsift.operators.numbering import number_rows
from docsift.session import Workspace

_STORED_SHIFT = 2**60
# A step of pointer doubling broadcasts its links only if they are within these bounds, as there are many steps.
STEP_ROWS = 1 << 17
STEP_BYTES = 4 * 1024 * 1024


def _token(place: Column) -> Column:
    both = F.col("doi").isNotNull() & F.col("content_fingerprint").isNotNull()
    return place * 2 + F.when(both, 1).otherwise(0)


def _has_both(token: Column) -> Column:
    return token.bitwiseAND(1)


def _place(token: Column) -> Column:
    return F.shiftright(token, 1)


def key_rows(records: DataFrame, place: Column) -> DataFrame:
    """(token, key) for each key a record has; the first letter tells DOI and fingerprint apart."""
    keys = F.array(
        F.concat(F.lit("d"), F.col("doi")), F.concat(F.lit("f"), F.col("content_fingerprint"))
    )
    return records.select(_token(place).alias("token"), F.explode(F.array_compact(keys)).alias("key"))


def _followers(pending: DataFrame, first: DataFrame, workspace: Workspace) -> DataFrame:
    """(token, root, flips): pending records that wait for a single earlier one, and where their chain begins.

    ``flips`` is the length of the way to ``root`` modulo two; ``root`` is no follower itself.
    """
    holders = first.select("key", F.col("token").alias("holder"))
    workspace.same_size(holders, first)
    waiting = join_lookup(pending, holders, ["key"], "inner", workspace).where("token <> holder")
    waiting = workspace.write(waiting, "waiting", measure=True)
    if not workspace.measured(waiting)[0]:
        return waiting.select("token", F.col("holder").alias("root"), F.lit(0).alias("flips"))
    second = waiting.groupBy("key").agg(F.min("token").alias("second"))
    second = workspace.write(second, "second-on-key", measure=True)
    links = (
        join_lookup(waiting, second, ["key"], "inner", workspace)
        .groupBy("token")
        .agg(
            F.max(F.col("token") > F.col("second")).alias("later"),
            F.min("holder").alias("root"), F.max("holder").alias("other"),
        )
        .where("NOT later AND root = other")
        .select("token", "root", F.lit(1).alias("flips"), F.lit(False).alias("done"))
    )
    links = workspace.write(links, "links", measure=True)
    while not links.where("NOT done").isEmpty():
        ahead = links.select(F.col("token").alias("root"), F.col("root").alias("next"), F.col("flips").alias("more"))
        workspace.same_size(ahead, links)
        moved = join_lookup(
            links.where("NOT done"), ahead, ["root"], "left", workspace, STEP_ROWS, STEP_BYTES
        ).select(
            "token", F.coalesce("next", "root").alias("root"),
            F.pmod(F.col("flips") + F.coalesce("more", F.lit(0)), F.lit(2)).alias("flips"),
            F.col("next").isNull().alias("done"),
        )
        links = workspace.write(links.where("done").unionByName(moved), "links", measure=True)
    return links.select("token", "root", "flips")


def claimed_keys(keys: DataFrame, workspace: Workspace) -> DataFrame:
    """(token, key): every claimed key with the kept record that claims it. ``keys`` is a written table."""
    claims: list[DataFrame] = []
    pending = keys
    per_record = Window.partitionBy("token")
    while True:
        first = pending.groupBy("key").agg(F.min("token").alias("token"))
        first = workspace.write(
            first.withColumn("kept", F.count("*").over(per_record) == 1 + _has_both(F.col("token"))), "first-on-key",
            measure=True,
        )
        claimed = first.where("kept").select("token", "key")
        if claims:
            roots = claimed.select(F.col("token").alias("root")).distinct()
            roots = workspace.write(roots, "roots", measure=True)
            even = _followers(pending, first, workspace).where("flips = 0")
            settled = join_lookup(even, roots, ["root"], "left_semi", workspace).select("token")
            claimed = workspace.write(claimed.unionByName(pending.join(settled, "token", "left_semi")), "claimed")
        claims.append(claimed)
        open_keys = first.select("key").join(claimed, "key", "left_anti")
        open_keys = workspace.write(open_keys, "open-keys", measure=True)
        if not workspace.measured(open_keys)[0]:
            break
        still_open = join_lookup(pending, open_keys, ["key"], "left_semi", workspace)
        pending = workspace.write(
            still_open.withColumn("open", F.count("*").over(per_record))
            .where(F.col("open") == 1 + _has_both(F.col("token")))
            .select("token", "key"),
            "pending", measure=True,
        )
        if not workspace.measured(pending)[0]:
            break
    return reduce(DataFrame.unionByName, claims)


def resolve_duplicates(
    records: DataFrame,
    stored: DataFrame,
    stored_count: int,
    workspace: Workspace,
) -> DataFrame:
    """Decide on every record: (line_order, id, existing_id, reason).

    ``records`` is a written table (line_order, doi, content_fingerprint). ``stored`` has the stored documents that
    share a key with one of them, each once with both its keys (id, doi, content_fingerprint); others change nothing.
    ``stored_count`` documents are stored in all, with ids from 1 on. Kept records have the next dense ``id`` in import
    order; duplicates have the ``existing_id`` they repeat and the ``reason``.
    """
    new_keys = workspace.write(key_rows(records, F.col("line_order")), "new-keys")
    all_keys = new_keys
    if stored_count:
        stored_keys = key_rows(stored, F.col("id") - _STORED_SHIFT)
        all_keys = workspace.write(stored_keys.unionByName(new_keys), "all-keys")
    claims = claimed_keys(all_keys, workspace)

    kept = claims.where("token >= 0").select("token").distinct()
    numbered = number_rows(kept, ["token"], "ordinal", workspace).select(
        "token", (F.col("ordinal") + 1 + stored_count).alias("id")
    )
    claim_ids = claims.where("token < 0").withColumn("id", _place(F.col("token")) + _STORED_SHIFT)
    claim_ids = claim_ids.unionByName(claims.where("token >= 0").join(numbered, "token"))
    lookup = workspace.write(
        claim_ids.select("key", F.col("token").alias("claim"), F.col("id").alias("claim_id")), "claims", measure=True
    )

    matched = join_lookup(new_keys, lookup, ["key"], "left", workspace)
    earlier = F.col("claim") < F.col("token")
    by_doi = F.col("key").startswith("d")
    per_record = matched.groupBy("token").agg(
        F.max(F.when(F.col("claim") == F.col("token"), F.col("claim_id"))).alias("id"),
        F.max(F.when(earlier & by_doi, F.col("claim"))).alias("doi_claim"),
        F.max(F.when(earlier & by_doi, F.col("claim_id"))).alias("doi_id"),
        F.max(F.when(earlier & ~by_doi, F.col("claim"))).alias("content_claim"),
        F.max(F.when(earlier & ~by_doi, F.col("claim_id"))).alias("content_id"),
        F.max((~by_doi).cast("int")).alias("has_content"),
    )
    has_doi = (_has_both(F.col("token")) == 1) | (F.col("has_content") == 0)
    reason = (
        F.when(F.col("id").isNotNull(), None)
        .when(
            F.col("doi_claim").isNotNull()
            & (F.col("has_content") == 1)
            & ~F.col("doi_claim").eqNullSafe(F.col("content_claim")),
            "duplicate_conflicting_content",
        )
        # Found by content only, so a DOI of the stored record must be another one.
        .when(F.col("doi_claim").isNull() & has_doi & (_has_both(F.col("content_claim")) == 1),
              "duplicate_conflicting_doi")
        .otherwise("duplicate_document")
    )
    return per_record.select(
        _place(F.col("token")).alias("line_order"),
        "id",
        F.when(F.col("id").isNull(), F.coalesce("doi_id", "content_id")).alias("existing_id"),
        reason.alias("reason"),
    )
