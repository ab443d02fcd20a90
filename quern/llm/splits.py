"""Splits that keep related records together: a persisted component table, merged by pointer jumping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.ids import clean_match_id, clean_player, key128
from quern.session import Workspace

SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def _jump(ws: Workspace, parent: DataFrame, tag: str) -> DataFrame:
    """node, root: parents (node, up) with up < node followed to the end, the distance doubling each time."""
    step = 0
    now = parent.select("node", "up")
    while True:
        far = now.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        nxt = now.join(far, "up", "left").select("node", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("moved"))
        kept = ws.save(nxt, f"{tag}-jump{step}")
        if step:
            ws.drop(f"{tag}-jump{step - 1}")
        now = kept.select("node", "up")
        if kept.where("moved").isEmpty():
            return now.select("node", F.col("up").alias("root"))
        step += 1


def components(links: DataFrame, ws: Workspace, name: str = "components", kept: bool = False) -> DataFrame:
    """node, component: nodes that share a link (node string, h1, h2) directly or through others.

    component is the smallest node, in plain string order, of the whole component; every non-null node has one row.
    A link with null h1 ties its node to nothing. Repeated rows change nothing; no rows give none.

    Each round hooks every component to the smallest one that any of its links leads to, follows the hooks to their
    roots by pointer jumping, and renames the links; links that lead to one component only are done and leave. Links
    are only aggregated (combined before the shuffle) and joined (adaptive skew joins split a hot link), never
    collected. What a round leaves is written to the shared folder, which cuts the lineage; the rounds' renamings are
    composed among themselves, the shortest first, and meet all nodes once. kept: links are already distinct and saved.
    """
    nodes = links.where(F.col("node").isNotNull()).select("node").distinct()
    live = links.where(F.col("node").isNotNull() & F.col("h1").isNotNull()).select("node", "h1", "h2")
    live, k = live if kept else ws.save(live.distinct(), "links0"), 0
    roots: list[DataFrame] = []
    while True:
        ends = live.groupBy("h1", "h2").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
        joined = live.join(ends.select("h1", "h2", "low"), ["h1", "h2"])
        hooks = joined.groupBy("node").agg(F.min("low").alias("up")).where("up < node")
        hooks = ws.save(hooks, f"hooks{k}")
        if hooks.isEmpty():
            break
        root = _jump(ws, hooks, f"round{k}")
        roots.append(root)
        moved = F.coalesce("root", "node").alias("node")
        nxt = joined.select("node", "h1", "h2").join(root, "node", "left").select(moved, "h1", "h2").distinct()
        fewer = ws.save(nxt, f"links{k + 1}")
        for old in (f"links{k}", f"hooks{k}"):
            ws.drop(old)
        live, k = fewer, k + 1
    # A round renames only nodes that no earlier round did: its own and the composed ones of those after it are disjoint.
    composed = None
    for root in reversed(roots):
        if composed is not None:
            after = composed.select(F.col("node").alias("root"), F.col("root").alias("last"))
            root = root.join(after, "root", "left").select("node", F.coalesce("last", "root").alias("root")).unionByName(composed)
        composed = root
    label = nodes.withColumn("component", F.col("node"))
    if composed is not None:
        label = nodes.join(composed, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
    out = ws.save(label, name)
    for done in [x for x in ws.names if x.startswith(("links", "hooks", "round"))]:
        ws.drop(done)
    return out


def match_links(participants: DataFrame) -> DataFrame:
    """node (match), h1, h2 (player key, null where a row names no player) of match participants with a match id."""
    p = clean_player(F.col("puuid"))
    rows = participants.select(clean_match_id(F.col("match_id")).alias("node"), p.alias("p")).where(F.col("node").isNotNull())
    return rows.select("node", *[F.when(F.col("p").isNotNull(), h).alias(f"h{i}") for i, h in enumerate(key128(F.col("p")), 1)])


def update_components(known: DataFrame | None, links: DataFrame, ws: Workspace, keys: DataFrame | None = None) -> DataFrame:
    """node, component, old: the component table after more links; old is the component a node had before, if any.

    known has node and component, keys has h1, h2 and component of the links seen before; neither is changed. Old
    components come in as links of their own, so only new links can merge them: of the keys, those that the new links
    use again. component may change to a smaller node when components merge.
    """
    if known is None:
        return components(links, ws).withColumn("old", F.lit(None).cast("string"))
    new = links.select("node", "h1", "h2")
    ties = known.select("node", *key128(F.concat(F.lit("component:"), F.col("component"))))
    if keys is not None:
        again = keys.join(new.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
        ties = ties.unionByName(again.select(F.col("component").alias("node"), "h1", "h2"))
    now = components(new.unionByName(ties), ws)
    return now.join(known.select("node", F.col("component").alias("old")), "node", "left")


def assign_splits(table: DataFrame, old_splits: DataFrame | None = None, splits=SPLITS, large_share: float = 0.001) -> DataFrame:
    """node, component, split: `table` is node, component, old; old_splits is component (the old one), split.

    A component that holds old components of one split keeps it. One that merges old components of different splits
    is a conflict and gets the split 'quarantine'. New components fill the deficits: those of at least large_share
    of all nodes (at most 1 / large_share of them, so they fit the driver) go one by one, largest first, to the
    split that lacks most; the others by a hash of their name, in proportion to what is then missing. Proportions
    hold over nodes, as far as components allow. Equal tables give equal splits.
    """
    spark = table.sparkSession
    if old_splits is None:
        old_splits = spark.createDataFrame([], "component string, split string")
    past = table.join(old_splits.select(F.col("component").alias("old"), "split"), "old", "left")
    sizes = past.groupBy("component").agg(F.count("*").alias("n"), F.min("split").alias("low"), F.max("split").alias("high"))
    sizes = sizes.select("component", "n", _kept().alias("kept"))
    held = {r["kept"]: r["n"] for r in sizes.groupBy("kept").agg(F.sum("n").alias("n")).collect()}
    named = _place(sizes, held, splits, large_share).select("component", "split")
    return table.select("node", "component").join(named, "component").select("node", "component", "split")


def _kept():
    """The split of a component from the lowest and highest split of what it merges."""
    return F.when(F.col("low").isNull(), None).when(F.col("low") == F.col("high"), F.col("low")).otherwise("quarantine")


def _place(sizes: DataFrame, held: dict, splits, large_share: float) -> DataFrame:
    """component, n, split: sizes (component, n, kept) with splits for those that keep none.

    held: nodes by split that are placed, under None those to be placed.
    """
    total = sum(n for k, n in held.items() if k != "quarantine")
    missing = {name: share * total - held.get(name, 0) for name, share in splits}
    large = sizes.where(F.col("kept").isNull() & (F.col("n") >= max(1.0, large_share * total))).orderBy(F.desc("n"), "component")
    chosen = []
    for r in large.collect() if large_share * total >= 1 else []:
        to = max(splits, key=lambda s: missing[s[0]])[0]
        missing[to] -= r["n"]
        chosen.append((r["component"], to))
    rest = {k: max(v, 0.0) for k, v in missing.items()}
    whole = sum(rest.values()) or 1.0
    at, by_hash = 0.0, F.lit(splits[-1][0])
    point = F.pmod(F.xxhash64(F.lit("split"), F.col("component")), F.lit(1_000_003)) / 1_000_003
    cuts = []
    for name, _ in splits:
        at += rest[name] / whole
        cuts.append((name, at))
    for name, cut in reversed(cuts[:-1]):
        by_hash = F.when(point < cut, name).otherwise(by_hash)
    picked = sizes.sparkSession.createDataFrame(chosen, "component string, picked string")
    named = sizes.join(F.broadcast(picked), "component", "left")
    return named.select("component", "n", F.coalesce("kept", "picked", by_hash).alias("split"))


class ComponentStore:
    """A component table under a folder that grows by batches; an update only adds a version of what is new.

    Version v holds nodes (node, component) and keys (h1, h2, component) first seen in it, under the names their
    components then had; renames (old, component), all names that merges have ended, with the present one;
    groups (component, split, n), the components that the batch made or changed; and sums (split, n) of all nodes.
    An update reads nodes, keys and groups once to find what the batch touches, and from there on works on the batch
    and the touched components' names alone: what it shuffles and writes is in proportion to the batch. An update
    that failed leaves no finished version and can be run again.
    """

    def __init__(self, spark: SparkSession, folder: str, splits=SPLITS, large_share: float = 0.001):
        self.spark, self.folder, self.splits, self.large_share = spark, folder.rstrip("/"), splits, large_share
        self.version = 0
        while self._finished(self.version + 1):
            self.version += 1

    def _finished(self, version: int) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v{version}/nodes/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _all(self, name: str, schema: str) -> DataFrame:
        """Rows of all versions of a table, with their version."""
        if not self.version:
            return self.spark.createDataFrame([], f"{schema}, version int")
        parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/v{v}/{name}").withColumn("version", F.lit(v)) for v in range(1, self.version + 1)]
        return reduce(DataFrame.unionByName, parts)

    def _renames(self) -> DataFrame:
        schema = "old string, component string"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/v{self.version}/renames") if self.version else self.spark.createDataFrame([], schema)

    def _named_now(self, df: DataFrame) -> DataFrame:
        """df with its component's present name."""
        now = self._renames().select(F.col("old").alias("component"), F.col("component").alias("_now"))
        return df.join(now, "component", "left").withColumn("component", F.coalesce("_now", "component")).drop("_now")

    def _groups(self) -> DataFrame:
        """component, split, n of every component, as its last version has it; merged names are among them."""
        rows = self._all("groups", "component string, split string, n bigint")
        last = rows.groupBy("component").agg(F.max(F.struct("version", "split", "n")).alias("x"))
        return last.select("component", "x.split", "x.n")

    def table(self, name: str = "nodes") -> DataFrame | None:
        """nodes: node, component, split; members: without the split; keys: h1, h2, component; as of the last version.

        None before the first one.
        """
        if not self.version:
            return None
        if name == "keys":
            return self._named_now(self._all("keys", "h1 bigint, h2 bigint, component string").drop("version")).select("h1", "h2", "component")
        nodes = self._named_now(self._all("nodes", "node string, component string").drop("version"))
        if name == "members":
            return nodes.select("node", "component")
        return nodes.join(self._groups().select("component", "split"), "component").select("node", "component", "split")

    def update(self, links: DataFrame) -> DataFrame:
        """The node table after more links (node, h1, h2).

        Components keep their splits, new ones fill what is missing, merged ones of different splits go to
        'quarantine'. Nulls, repeated rows and empty batches are as in `components`.
        """
        ws = workspace(self.spark)
        batch = ws.save(links.where(F.col("node").isNotNull()).select("node", "h1", "h2").distinct(), "batch")
        mini = batch.withColumn("known", F.lit(None).cast("string"))
        tied = None
        if self.version:
            nodes = self._all("nodes", "node string, component string").drop("version").join(batch.select("node").distinct(), "node", "left_semi")
            own = self._named_now(nodes).select("node", F.col("component").alias("known"))
            mini = batch.join(own, "node", "left")
            keys = self._all("keys", "h1 bigint, h2 bigint, component string").drop("version").join(batch.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
            tied = ws.save(self._named_now(keys).select(F.col("component").alias("node"), "h1", "h2"), "tied")
        mini = ws.save(mini.select("node", "h1", "h2", "known"), "mini") if self.version else mini
        named = mini.select(F.coalesce("known", "node").alias("node"), "h1", "h2")
        comps = components(named, ws, kept=True) if tied is None else components(named.unionByName(tied), ws)
        # Old components among the names, with the split and size they had.
        touched = mini.where(F.col("known").isNotNull()).select(F.col("known").alias("component"))
        touched = (touched if tied is None else touched.unionByName(tied.select(F.col("node").alias("component")))).distinct()
        past = ws.save(self._groups().join(touched, "component").select(F.col("component").alias("node"), "split", "n"), "past") if self.version else self.spark.createDataFrame([], "node string, split string, n bigint")
        merged = comps.join(past, "node", "left")
        sizes = merged.groupBy("component").agg(F.sum(F.coalesce("n", F.lit(1))).alias("n"), F.min("split").alias("low"), F.max("split").alias("high"))
        sizes = ws.save(sizes.select("component", "n", _kept().alias("kept")), "sizes")
        held = self._sums()
        for r in past.groupBy("split").agg(F.sum("n").alias("n")).collect():
            held[r["split"]] = held.get(r["split"], 0) - r["n"]
        for r in sizes.groupBy("kept").agg(F.sum("n").alias("n")).collect():
            held[r["kept"]] = held.get(r["kept"], 0) + r["n"]
        placed = ws.save(_place(sizes, held, self.splits, self.large_share), "placed")
        held.pop(None, None)
        for r in placed.join(sizes.where("kept is null").select("component"), "component", "left_semi").groupBy("split").agg(F.sum("n").alias("n")).collect():
            held[r["split"]] = held.get(r["split"], 0) + r["n"]
        to = f"{self.folder}/v{self.version + 1}"
        ended = comps.join(past.select("node"), "node", "left_semi").where("node <> component").select(F.col("node").alias("old"), "component")
        again = self._renames().join(ended.select(F.col("old").alias("component"), F.col("component").alias("_next")), "component", "left")
        renames = again.select("old", F.coalesce("_next", "component").alias("component")).unionByName(ended)
        renames.write.mode("overwrite").parquet(f"{to}/renames")
        new_keys = mini.where(F.col("h1").isNotNull())
        if tied is not None:
            new_keys = new_keys.join(tied.select("h1", "h2"), ["h1", "h2"], "left_anti")
        new_keys = new_keys.select(F.coalesce("known", "node").alias("node"), "h1", "h2").join(comps, "node").select("h1", "h2", "component").distinct()
        new_keys.write.mode("overwrite").parquet(f"{to}/keys")
        placed.select("component", "split", "n").write.mode("overwrite").parquet(f"{to}/groups")
        self.spark.createDataFrame([(k, int(n)) for k, n in held.items()], "split string, n bigint").coalesce(1).write.mode("overwrite").parquet(f"{to}/sums")
        fresh = mini.where(F.col("known").isNull()).select("node").distinct() if self.version else None
        new_nodes = comps if fresh is None else comps.join(fresh, "node", "left_semi")
        new_nodes.select("node", "component").write.mode("overwrite").parquet(f"{to}/nodes")
        self.version += 1
        ws.clear()
        return self.table()

    def _sums(self) -> dict:
        """Nodes by split, of at most one row for each."""
        if not self.version:
            return {}
        return {r["split"]: r["n"] for r in self.spark.read.schema("split string, n bigint").parquet(f"{self.folder}/v{self.version}/sums").collect()}


def workspace(spark: SparkSession) -> Workspace:
    return Workspace(spark, "components")
