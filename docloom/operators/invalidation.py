"""What later records take from earlier ones of a page: references and claims that were invalidated, and what rested on them.

Each table holds the parts of a page's records, by page_id and sequence. A reference is stale for a record if a later record invalidated
it, which is so if its last invalidation is later: an as-of join that comes down to a maximum by (page, reference). Records
written by hand are left as they are. Nothing is gathered by page: all steps are joins on (page, reference), (page, claim) or (page, record).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources.store import written

RECORD = ["page_id", "sequence"]


def since_delete(rows: DataFrame, deletes: DataFrame) -> DataFrame:
    """Rows (page_id, sequence, ...) after their page's last delete (page_id, sequence)."""
    cut = deletes.groupBy("page_id").agg(F.max("sequence").alias("__deleted"))
    return rows.join(cut, "page_id", "left").filter(F.col("__deleted").isNull() | (F.col("sequence") > F.col("__deleted"))).drop("__deleted")


class Invalidation:
    """The stale references and dropped claims of pages.

    records: page_id, sequence, artifact_type, invalidated_refs, invalidated_claims; units: page_id, sequence, evidence_id, claim, refs. Sequence
    numbers are unique on a page.
    """

    def __init__(self, records: DataFrame, units: DataFrame):
        self.records, self.units = records, units
        last = lambda c, name: records.select(*RECORD, F.explode(c).alias(name)).groupBy("page_id", name).agg(F.max("sequence").alias("last"))
        self.refs = written(last("invalidated_refs", "ref"))
        self.by_hand = records.filter("artifact_type = 'manual'").select(*RECORD)
        automatic = records.filter("NOT artifact_type <=> 'manual'")
        first = automatic.groupBy("page_id").agg(F.min("sequence").alias("first"))
        # A claim is dropped on the whole page: invalidated after any record that is not by hand, or resting on what is stale.
        claims = last("invalidated_claims", "evidence_id").join(first, "page_id").filter("last > first").select("page_id", "evidence_id")
        rested = self._stale(units.select(*RECORD, "evidence_id", F.explode("refs").alias("ref"))).select("page_id", "evidence_id")
        self.dropped = written(claims.union(rested).distinct())

    def _stale(self, cited: DataFrame) -> DataFrame:
        """Of rows (page_id, sequence, ref, ...) of records that are not by hand those whose reference was invalidated later."""
        return cited.join(self.refs, ["page_id", "ref"]).filter("last > sequence").drop("last").join(self.by_hand, RECORD, "left_anti")

    def _automatic(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.by_hand, RECORD, "left_anti")

    def left_units(self) -> DataFrame:
        """The units that stay."""
        return self.units.join(self._dropped_units(), [*RECORD, "evidence_id"], "left_anti")

    def _dropped_units(self) -> DataFrame:
        return self._automatic(self.units).join(self.dropped, ["page_id", "evidence_id"], "left_semi").select(*RECORD, "evidence_id").distinct()

    def left_refs(self, cited: DataFrame) -> DataFrame:
        """Rows (page_id, sequence, ref, ...) of a record's own citations without stale ones and those that only its dropped units had."""
        cell = [*RECORD, "ref"]
        gone = self.units.join(self._dropped_units(), [*RECORD, "evidence_id"], "left_semi").select(*RECORD, F.explode("refs").alias("ref")).distinct()
        held = self.left_units().select(*RECORD, F.explode("refs").alias("ref")).distinct()
        without = self._stale(cited.select(*cell)).union(gone.join(held, cell, "left_anti")).distinct()
        return cited.join(without, cell, "left_anti")

    def left_claims(self, cited: DataFrame) -> DataFrame:
        """Rows (page_id, sequence, evidence_id, ...) without dropped claims."""
        cell = [*RECORD, "evidence_id"]
        return cited.join(self._automatic(cited.select(*cell)).join(self.dropped, ["page_id", "evidence_id"], "left_semi").distinct(), cell, "left_anti")

    def left_points(self, points: DataFrame) -> DataFrame:
        """Key points (page_id, sequence, place, text, refs) without a stale reference that are not a dropped unit of their record."""
        key = [*RECORD, "place"]
        stale = self._stale(points.select(*key, F.explode("refs").alias("ref"))).select(*key)
        same = F.array_sort(F.array_distinct("refs"))
        units = self.units.join(self._dropped_units(), [*RECORD, "evidence_id"], "left_semi").select(*RECORD, F.col("claim").alias("text"), same.alias("as_set")).distinct()
        rested = points.withColumn("as_set", same).join(units, [*RECORD, "text", "as_set"], "left_semi").select(*key)
        return points.join(stale.union(rested).distinct(), key, "left_anti")

    def left_changes(self, changes: DataFrame) -> DataFrame:
        """Changes of sub-entries (page_id, sequence, place, op, refs, claims): adds keep the references and claims that hold, and go if they had some and
        keep none; others stay."""
        key = [*RECORD, "place"]
        adds = changes.filter("op = 'add'")
        refs = adds.select(*key, F.posexplode("refs").alias("at", "ref"))
        stale = self._stale(refs.select(*RECORD, "ref")).distinct()
        claims = adds.select(*key, F.posexplode("claims").alias("at", "evidence_id"))
        gather = lambda rows, c, name: rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c]).alias(name))
        kept = adds.select(*key, ((F.size("refs") > 0) | (F.size("claims") > 0)).alias("cited"))
        kept = kept.join(gather(refs.join(stale, [*RECORD, "ref"], "left_anti"), "ref", "kept_refs"), key, "left").join(gather(self.left_claims(claims), "evidence_id", "kept_claims"), key, "left")
        left = kept.filter("NOT coalesce(cited, false) OR kept_refs IS NOT NULL OR kept_claims IS NOT NULL").drop("cited")
        kinds = dict(changes.dtypes)
        or_none = lambda c: F.coalesce(f"kept_{c}", F.array().cast(kinds[c])).alias(c)
        others = [c for c in changes.columns if c not in ("refs", "claims")]
        return adds.join(left, key).select(*others, or_none("refs"), or_none("claims")).unionByName(changes.filter("NOT op <=> 'add'"))


def first_places(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Rows (keys..., name): the distinct values of rows (keys..., sequence, array value) by their first place."""
    each = rows.select(*keys, "sequence", F.posexplode(value).alias("at", "value")).groupBy(*keys, "value").agg(F.min(F.struct("sequence", "at")).alias("first"))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "value"))).alias("x")).select(*keys, F.transform("x", lambda x: x["value"]).alias(name))


def merged_evidence(units: DataFrame) -> DataFrame:
    """Of each page's units (page_id, sequence, place, evidence_id, ...) one by evidence_id, in the last version and the first place: with rank."""
    at = F.struct("sequence", "place")
    others = [c for c in units.columns if c not in ("page_id", "evidence_id", "sequence", "place")]
    one = units.groupBy("page_id", "evidence_id").agg(F.min(at).alias("first"), F.max_by(F.struct(*others), at).alias("x"))
    return one.select("page_id", "evidence_id", "first", "x.*")


def merged_points(points: DataFrame) -> DataFrame:
    """A page's key points (page_id, sequence, place, text, refs), once for each text and list of references, with their first place."""
    return points.groupBy("page_id", F.coalesce("text", F.lit("")).alias("text"), "refs").agg(F.min(F.struct("sequence", "place")).alias("first"))
