"""The update cycle: resolve, gate, publish all or nothing, and a record of what came of it."""

from __future__ import annotations

import traceback
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from addrflow.sources.scratch import kept
from addrflow.sources.store import check_unpublished, current_version, hashed_part, publish_version, read_current

from . import addresses, publish, quality

TABLES = ("point", "locality", "street")
PART_COUNTS = ("parts_kept", "parts_written")
RUN_SCHEMA = "version string, outcome string, reason string, warnings array<string>, added long, changed long, restored long, withdrawn long, unchanged long, parts_kept long, parts_written long, trace string"


def publish_state(state: dict[str, DataFrame], staged: dict[str, DataFrame], as_of, regions: list[str] | None = None, others: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables after a snapshot, merged points with their class): P2 to P10 in their order.

    References of staged points and streets are resolved against the merged localities, where they are given as such.
    Merged tables are kept in scratch folders, as counts and links read them again.  ``others`` are published points that no
    staged row touches: they only count for their streets and localities."""
    localities = kept("localities", publish.merge_localities(state["locality"], staged["locality"]))
    points, streets = staged["point"], staged["street"]
    if "locality_ref" in points.columns and "locality_ref" in streets.columns:
        points, streets = addresses.resolve_refs(points, streets, localities)
    # The merge of streets without a code reads the others three times.
    coded = kept("coded", publish.merge_streets(state["street"], publish.split_type_words(streets), localities))
    catalogue = kept("catalogue", publish.merge_uncoded_streets(coded, streets, localities))
    if "street_ref" in points.columns:
        points = addresses.link_streets(points.drop("street_id"), streets, catalogue)
    merged = kept("merged", publish.merge_points(state["point"], points, as_of, regions))
    done = merged.drop("class")
    needed = ["street_id", "simc", "withdrawn"]
    active = done.select(needed) if others is None else done.select(needed).unionByName(others.select(needed))
    own_streets, own_localities = publish.refresh_derived(active, catalogue, localities)
    return {"point": done, "street": own_streets, "locality": own_localities}, merged


@dataclass
class Cycle:
    """A published registry under ``root`` and how it is updated.

    Points are published in parts by region and id, streets and localities in parts by id (16 ** ``digits`` each)."""

    spark: SparkSession
    root: str
    thresholds: dict = field(default_factory=dict)
    digits: int = 1

    def state(self) -> dict[str, DataFrame]:
        return {t: read_current(self.spark, self.root, t) for t in TABLES}

    def run(self, version: str, staged, changed: list[str], as_of, dry_run: bool = False, last_published_days: float = 0.0) -> str:
        """One cycle; its outcome is published, no_change, held or error, and a row of ``runs`` says why.

        ``staged`` makes the staged tables when they are needed; ``changed`` lists the regions whose files changed.  The
        pointer moves last, so whatever fails before leaves the published version as it was; the row keeps the trace."""
        outcome, reason, warnings, counts, trace = "error", None, [], {}, None
        try:
            if not changed:
                outcome = "no_change"
            else:
                outcome, reason, warnings, counts = self._update(version, staged(), changed, as_of, dry_run, last_published_days)
        except Exception as e:  # a cycle reports every failure as its outcome
            reason, trace = str(e).splitlines()[0][:500] if str(e) else type(e).__name__, traceback.format_exc()
        row = (version, outcome, reason, warnings, *(counts.get(k) for k in ("added", "changed", "restored", "withdrawn", "unchanged", *PART_COUNTS)), trace)
        self.spark.createDataFrame([row], RUN_SCHEMA).write.mode("append").parquet(f"{self.root}/runs")
        return outcome

    def _update(self, version: str, staged: dict[str, DataFrame], changed: list[str], as_of, dry_run: bool, days: float):
        first = current_version(self.spark, self.root) is None
        state = {t: df.limit(0) for t, df in staged.items()} if first else self.state()
        points = staged["point"].where(F.col("region").isin(*changed))
        report = quality.quality_report(state["point"], points, self.thresholds, days, changed).collect()
        failed = [r["gate"] for r in report if not r["ok"] and r["level"] == "blocking"]
        warnings = [r["gate"] for r in report if not r["ok"] and r["level"] != "blocking"]
        if failed:
            return "held", ", ".join(failed), warnings, {}
        if dry_run:
            return "no_change", "dry run", warnings, {}
        # Before the merge, not after it.
        check_unpublished(self.spark, self.root, version)
        within, others = None, None
        if not first:
            # Beside the changed regions, those that staged points come from: the rest is neither merged nor written.
            every = {r["region"] for r in state["point"].select("region").distinct().collect()}
            touched = set(changed)
            if every - touched:
                away = state["point"].where(~F.col("region").isin(*changed)).join(points.select("point_id"), "point_id", "left_semi").select("region").distinct()
                touched |= {r["region"] for r in away.collect()}
            within = {"point": touched}
            state["point"] = read_current(self.spark, self.root, "point", touched)
            others = read_current(self.spark, self.root, "point", every - touched)
        tables, merged = publish_state(state, {**staged, "point": points}, as_of, changed, others)
        # Parts are compared, then written.
        tables |= {t: kept(t, tables[t]) for t in ("street", "locality")}
        # Counts and tables read the same state and staging, which the new version doesn't touch.
        counts = publish.publish_summary(merged).first().asDict()
        parts = {"point": hashed_part("point_id", self.digits, "region"), "street": hashed_part("street_id", self.digits), "locality": hashed_part("simc", self.digits)}
        written = publish_version(tables, self.root, version, parts, within)
        sums = dict(zip(PART_COUNTS, map(sum, zip(*written.values(), strict=True)), strict=True))
        return "published", None, warnings, counts | sums

    def runs(self) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(f"{self.root}/runs")
