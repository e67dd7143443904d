"""The batch plan over one set of tables: each step is built once and shared by the queries that need it."""

from __future__ import annotations

import argparse
import hashlib
import json
import posixpath
import uuid
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import addresses, features, models, ranking, reports, subnetworks
from ..sources import tables
from ..sources.tables import saved, stored
from ..sources.versions import VersionedTable


@dataclass(frozen=True)
class Settings:
    """Parameters of the batch run. label_col names the labels that seeds and edges follow: class_label (actual), pred_class_label (predicted) or
    final_class_label (actual where known, else predicted)."""

    label_col: str = "class_label"
    threshold: float = 0.4
    max_hops: int | None = None
    min_shared_nodes: int = 1
    alpha: float = 0.85
    max_iter: int = 100
    tol: float = 1e-8
    weights: dict = field(default_factory=lambda: dict(ranking.WEIGHTS))
    invert_out_degree: bool = True
    complete_missing: bool = True
    join_text: bool = True


class Workspace:
    """Score, grow subnetworks, merge, rank, summarise. Shared steps are written to the checkpoint folder; the rest stay plans."""

    def __init__(self, spark: SparkSession, sf_dir: str, settings: Settings | None = None, bundle: models.Bundle | None = None):
        """bundle: the fitted model that scores the transactions; without one the test tables' stand-in scores serve."""
        self.spark, self.dir, self.s, self.bundle = spark, sf_dir, settings or Settings(), bundle

    @cached_property
    def features(self) -> DataFrame:
        return stored(tables.txn_features(self.spark, self.dir, self.edgelist))

    @cached_property
    def classes(self) -> DataFrame:
        return tables.txn_classes(self.spark, self.dir)

    @cached_property
    def scores(self) -> DataFrame:
        if self.bundle is None:
            return tables.scores(self.spark, self.dir)
        known = self.classes.select("txId", "class_label", F.when(F.col("class_label") == tables.ILLICIT, 1).when(F.col("class_label") == tables.LICIT, 0).alias("class"))
        found = models.score(self.bundle, self.features.join(known, "txId"))
        return saved(found.select("txId", "time_step", "class_label", "class", "pred_proba"))

    @cached_property
    def clean(self) -> DataFrame:
        return features.clean_features(self.features, self.classes)

    @cached_property
    def predictions(self) -> DataFrame:
        return reports.final_labels(reports.threshold_predictions(self.scores, self.s.threshold))

    @cached_property
    def labels(self) -> DataFrame:
        """txId and the label column of the settings."""
        return self.classes if self.s.label_col in self.classes.columns else self.predictions

    @cached_property
    def edgelist(self) -> DataFrame:
        return stored(tables.txn_edgelist(self.spark, self.dir))

    @cached_property
    def allowed(self) -> DataFrame:
        return stored(subnetworks.allowed_edges(self.edgelist, self.labels, self.s.label_col))

    @cached_property
    def seeds(self) -> DataFrame:
        return stored(subnetworks.number_seeds(self.labels, self.s.label_col))

    @cached_property
    def reached(self) -> DataFrame:
        return subnetworks.reach(self.seeds, self.allowed, self.s.max_hops)

    @cached_property
    def nodes(self) -> DataFrame:
        return subnetworks.subnet_nodes(self.reached)

    @cached_property
    def edges(self) -> DataFrame:
        return subnetworks.subnet_edges(self.reached, self.allowed, self.s.max_hops)

    @cached_property
    def report(self) -> DataFrame:
        return saved(subnetworks.dedup_report(self.nodes, by_reach=self.s.max_hops is None))

    @cached_property
    def kept_reached(self) -> DataFrame:
        """What the subnetworks that dedup keeps reach. Without a hop limit those are known before any traversal, so the subnetworks that dedup would
        drop are never grown."""
        if self.s.max_hops is None:
            return subnetworks.reach(subnetworks.kept_seeds(self.seeds, self.allowed), self.allowed)
        return saved(self.reached.join(self.report.where("status = 'kept'").select(F.col("id").alias("subnetwork_id")), "subnetwork_id", "left_semi"))

    @cached_property
    def kept_nodes(self) -> DataFrame:
        return subnetworks.subnet_nodes(self.kept_reached)

    @cached_property
    def kept_edges(self) -> DataFrame:
        return subnetworks.subnet_edges(self.kept_reached, self.allowed, self.s.max_hops)

    @cached_property
    def merged_ids(self) -> DataFrame:
        return saved(subnetworks.merge_ids(self.kept_nodes, self.s.min_shared_nodes))

    @cached_property
    def nodes_retagged(self) -> DataFrame:
        return subnetworks.retag(self.kept_nodes, self.merged_ids)

    @cached_property
    def edges_retagged(self) -> DataFrame:
        return subnetworks.retag(self.kept_edges, self.merged_ids)

    @cached_property
    def nodes_final(self) -> DataFrame:
        return stored(subnetworks.collapse_nodes(self.nodes_retagged))

    @cached_property
    def edges_final(self) -> DataFrame:
        return stored(subnetworks.collapse_edges(self.edges_retagged))

    @cached_property
    def summary(self) -> DataFrame:
        return subnetworks.summarise(self.nodes_retagged, self.edges_retagged)

    @cached_property
    def pagerank(self) -> DataFrame:
        return saved(ranking.pagerank(self.edges_final, alpha=self.s.alpha, max_iter=self.s.max_iter, tol=self.s.tol))

    @cached_property
    def pagerank_completed(self) -> DataFrame:
        return ranking.complete_pagerank(self.pagerank, self.nodes_final) if self.s.complete_missing else self.pagerank

    @cached_property
    def composite(self) -> DataFrame:
        return stored(ranking.composite(self.features, self.pagerank_completed, self.nodes_final, self.s.weights, self.s.invert_out_degree))

    @cached_property
    def ranked(self) -> DataFrame:
        """The composite with each node's least hop in its group."""
        return self.composite.join(self.nodes_final.select("merged_subnetwork_id", F.col("txn_id").alias("node"), "min_hop"), ["merged_subnetwork_id", "node"], "left")

    @cached_property
    def addr_txn(self) -> DataFrame:
        return tables.addr_txn(self.spark, self.dir)

    @cached_property
    def txn_addr(self) -> DataFrame:
        return tables.txn_addr(self.spark, self.dir)

    @cached_property
    def summary_table(self) -> VersionedTable:
        """The summary as a stored table that rows of a subnetwork are looked up in."""
        table = VersionedTable(self.spark, posixpath.join(tables.shared_folder(self.spark), f"summary-{uuid.uuid4().hex}"), ["subnetwork_id"])
        table.replace(self.txn_summary)
        return table

    @cached_property
    def txn_summary(self) -> DataFrame:
        return stored(addresses.txn_summary(self.ranked, self.addr_txn, self.txn_addr, self.s.join_text))


_last: tuple[tuple, Workspace] | None = None


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The workspace of the last directory asked for in this application, so that queries over the same tables share their steps, as long as the
    tables stay as they are: it is built anew when a table's size, number of files or time of change differs."""
    global _last
    key = (spark.sparkContext.applicationId, sf_dir, tables.state(spark, sf_dir))
    if _last is None or _last[0] != key:
        _last = (key, Workspace(spark, sf_dir))
    return _last[1]


def forget() -> None:
    global _last
    _last = None


#: The steps of the batch in order: the settings that each follows, and its tables with the workspace's steps behind them.
STEPS: dict[str, tuple[tuple[str, ...], dict[str, str]]] = {
    "classify": (("threshold",), {"df_txn_pred": "predictions"}),
    "subnetwork": (("label_col", "max_hops", "min_shared_nodes"), {"df_nw_txn_final": "nodes_final", "df_network_edges": "edges_final", "network_summary": "summary"}),
    "rank": (("alpha", "max_iter", "tol", "weights", "invert_out_degree", "complete_missing"), {"df_rank_composite": "composite", "df_rank_pr": "pagerank"}),
    "summary": (("join_text",), {"df_subnetwork_summary": "txn_summary"}),
}


class Batch:
    """The batch run into a folder. All state passes between steps through the tables there; a record beside them says what each step was made from: the
    input tables' state, the settings it follows, the model, and the record of the step before."""

    def __init__(self, spark: SparkSession, sf_dir: str, out: str, settings: Settings | None = None, bundle: models.Bundle | str | None = None, write_pagerank: bool = True):
        self.spark, self.out, self.write_pagerank = spark, out, write_pagerank
        self.model = bundle if isinstance(bundle, str) else None if bundle is None else [bundle.name, bundle.threshold, bundle.columns, str(bundle.model.uid)]
        self.w = Workspace(spark, sf_dir, settings, models.Bundle.load(spark, bundle) if isinstance(bundle, str) else bundle)
        self.found = {t: str(s) for t, s in (("input", tables.state(spark, sf_dir)), ("model", tables.state(spark, bundle) if isinstance(bundle, str) else self.model))}

    def _tables(self, step: str) -> dict[str, str]:
        return {t: p for t, p in STEPS[step][1].items() if self.write_pagerank or t != "df_rank_pr"}

    def key(self, step: str) -> str:
        """What the step is made from, as one hash."""
        names, before = list(STEPS), ""
        for name in names[: names.index(step) + 1]:
            chosen = {k: getattr(self.w.s, k) for k in STEPS[name][0]}
            before = hashlib.sha256(json.dumps([before, self.found, chosen, sorted(self._tables(name))], sort_keys=True).encode()).hexdigest()
        return before

    def _record(self, step: str) -> str:
        return f"{self.out}/_steps/{step}"

    def done(self, step: str) -> bool:
        """Whether the step's tables in the folder are those that it would make now."""
        path = self.w.spark._jvm.org.apache.hadoop.fs.Path(self._record(step))
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return False
        return self.spark.read.text(self._record(step), wholetext=True).first()[0].strip() == self.key(step)

    def load(self, step: str) -> None:
        """Lets later steps read the step's tables from the folder."""
        for table, name in self._tables(step).items():
            self.w.__dict__[name] = self.spark.read.parquet(f"{self.out}/{table}")

    def run(self, step: str) -> dict[str, DataFrame]:
        """Makes and writes the step's tables, from those that the steps before it have left in the folder, and records it. Without a seed only the first step writes."""
        names = list(STEPS)
        for before in names[: names.index(step)]:
            self.load(before)
        if step != "classify" and not self.w.seeds.take(1):
            return {}
        for table, name in self._tables(step).items():
            tables.write_table(getattr(self.w, name), f"{self.out}/{table}")
        self._mark(step)
        self.load(step)
        return {t: self.w.__dict__[n] for t, n in self._tables(step).items()}

    def _mark(self, step: str) -> None:
        path = self.w.spark._jvm.org.apache.hadoop.fs.Path(self._record(step))
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(self.key(step).encode())
        out.close()


def run_batch(spark: SparkSession, sf_dir: str, out: str, settings: Settings | None = None, dry_run: bool = False, bundle: models.Bundle | str | None = None, write_pagerank: bool = True, resume: bool = False) -> dict[str, DataFrame]:
    """The whole batch: classify (with bundle, a fitted model or the folder it was saved in), grow and merge subnetworks, rank, summarise. Each table
    is written below out unless dry_run; df_rank_pr only with write_pagerank. A run without seeds writes its predictions only and leaves
    older tables as they are. resume: steps whose tables in out were made from the same tables, settings and model are read instead of made anew."""
    b = Batch(spark, sf_dir, out, settings, bundle, write_pagerank)
    result: dict[str, DataFrame] = {}
    for step in STEPS:
        if step != "classify" and not b.w.seeds.take(1):
            break
        if dry_run:
            result |= {t: getattr(b.w, n) for t, n in b._tables(step).items()}
        elif resume and b.done(step):
            b.load(step)
            result |= {t: b.w.__dict__[n] for t, n in b._tables(step).items()}
        else:
            result |= b.run(step)
    return result


def main(argv: list[str] | None = None) -> None:
    """A step of the batch, or all of them, from the command line: python -m ledgerloom.plans.workspace --input DIR --out DIR [--step rank] [--set alpha=0.9]..."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("--input", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--step", choices=list(STEPS))
    parser.add_argument("--model", help="folder of a saved model")
    parser.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="a setting, its value as JSON or plain text")
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--resume", action="store_true")
    parser.add_argument("--no-pagerank", action="store_true")
    a = parser.parse_args(argv)
    chosen = {}
    for name, _, value in (x.partition("=") for x in a.set):
        if name not in Settings.__dataclass_fields__:
            parser.error(f"no setting {name}")
        try:
            chosen[name] = json.loads(value)
        except ValueError:
            chosen[name] = value
    spark = SparkSession.builder.getOrCreate()
    if a.step and not a.dry_run:
        Batch(spark, a.input, a.out, Settings(**chosen), a.model, not a.no_pagerank).run(a.step)
    else:
        run_batch(spark, a.input, a.out, Settings(**chosen), a.dry_run, a.model, not a.no_pagerank, a.resume)


if __name__ == "__main__":
    main()
