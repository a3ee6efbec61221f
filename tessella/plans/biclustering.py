"""The biclustering loop: every iteration is a short chain of DataFrame jobs over written state."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.config import Settings
from tessella.functions.order import indexed
from tessella.operators import clusters as cl
from tessella.operators import combine as cb
from tessella.operators import membership as mb
from tessella.operators import motifs as mo
from tessella.operators import networks as nw
from tessella.operators import scores as sc
from tessella.operators import seeding as sd
from tessella.operators import tiles
from tessella.operators.matrix import overlay_matrices
from tessella.session import drop_unused, materialize, recorded, spread
from tessella.sources import writers


class MotifSource:
    """Finds words enriched in each cluster's sequences and scans all sequences with their matrices.

    Clusters whose members did not change keep their earlier motifs and hits.
    """

    def __init__(self, seqs: DataFrame, width: int = 6, n_motifs: int = 2, sizes: tuple[int, int] = (3, 70)):
        self.seqs, self.width, self.n_motifs, self.sizes = materialize(seqs.select("id", "seq"), "seqs"), width, n_motifs, sizes
        of = self.seqs.agg(*[F.sum(F.length("seq") - F.length(F.replace(F.col("seq"), F.lit(x), F.lit("")))).alias(x) for x in "ACGT"]).first()
        total = sum(of[x] or 0 for x in "ACGT")
        #: Letter shares of the sequences, the background of the log odds and of their null distributions.
        self.background = {x: max(of[x], 1) / total for x in "ACGT"} if total else None
        self.members: DataFrame | None = None
        self.motifs: DataFrame | None = None
        self.pssm: DataFrame | None = None
        self.hits: DataFrame | None = None

    def search(self, row_member: DataFrame) -> DataFrame:
        todo = row_member
        if self.members is not None:
            todo = row_member.join(mo.changed_clusters(self.members, row_member), "k", "left_semi")
        motifs, pssm = mo.discover_kmers(self.seqs, todo, self.width, self.n_motifs, min_size=self.sizes[0], max_size=self.sizes[1])
        pssm = materialize(pssm, "pssm")
        whole = mo.sequence_pvalue(mo.scan_pssm(self.seqs, pssm, self.background, sizes=True))
        found = whole.groupBy("k", F.col("id").alias("row_id")).agg(F.min("pvalue").alias("pvalue"))
        if self.members is not None:
            same = row_member.select("k").distinct().join(todo.select("k").distinct(), "k", "left_anti")
            motifs = motifs.unionByName(self.motifs.join(same, "k", "left_semi"))
            pssm = pssm.unionByName(self.pssm.join(same, "k", "left_semi"))
            found = found.unionByName(self.hits.join(same, "k", "left_semi"))
        self.motifs, self.pssm, self.hits = materialize(motifs, "motifs"), materialize(pssm, "pssm"), materialize(found, "hits")
        self.members = row_member
        return self.hits

    def sites(self, row_member: DataFrame) -> DataFrame:
        """(k, mot, id, pos, strand, score, pvalue): the best hit of every motif on the sequences of its own cluster's members."""
        best = mo.scan_pssm(self.seqs, self.pssm, self.background)
        return best.join(row_member.select("k", F.col("row_id").alias("id")).distinct(), ["k", "id"], "left_semi")


class BiclusterRun:
    """State and iteration of one run. Matrices, networks and members are tables; the driver holds scalars."""

    #: Tables of the genome that go with an export.
    GENOME = ("feature_tab", "feature_names", "operons")

    def __init__(
        self, spark: SparkSession, matrices: Mapping[str, DataFrame], settings: Settings, networks: Mapping[str, DataFrame] | None = None,
        groups: DataFrame | None = None, motifs: MotifSource | None = None,
    ):
        self.spark, self.settings, self.motifs, self.groups = spark, settings, motifs, groups
        self.scaled_groups: DataFrame | None = None
        self.scratch: list[str] = []
        ready = settings.preprocess or (lambda m: m)
        self.matrices = {n: materialize(ready(m).select("row_id", "col_id", "value"), "matrix") for n, m in matrices.items()}
        self.row_weights = settings.normalized(settings.row_weights or {n: 1.0 for n in matrices})
        self.networks = {n: materialize(e.select("src", "dst", "weight"), "network") for n, e in (networks or {}).items()}
        self.net_weights = settings.normalized(settings.net_weights or {n: 1.0 for n in [*self.networks, *(["groups"] if groups is not None else [])]})
        self.axes = {n: materialize(tiles.column_axis(m), "axis") for n, m in self.matrices.items()}
        self.vectors = {n: materialize(spread(tiles.pack_rows(m, self.axes[n]), "row_id"), "vectors") for n, m in self.matrices.items()}
        rows = cols = None
        for m in self.matrices.values():
            r, c = m.select("row_id").distinct(), m.select("col_id").distinct()
            rows, cols = (r, c) if rows is None else (rows.unionByName(r).distinct(), cols.unionByName(c).distinct())
        self.rows, self.cols = materialize(rows, "rows"), materialize(cols, "cols")
        self.n_rows, self.n_cols = self.rows.count(), self.cols.count()
        self.per_col = settings.columns_per_cluster(self.n_cols)
        self.ks = spark.range(1, settings.n_clusters + 1).select(F.col("id").cast("int").alias("k"))
        self.iteration = 0
        self.row_member: DataFrame | None = None
        self.col_member: DataFrame | None = None
        self.row = self.col = self.mot = self.net = self.hits = None
        self.stats: list[DataFrame] = []

    def overlay(self) -> DataFrame:
        if len(self.matrices) == 1:
            return next(iter(self.matrices.values()))
        names = list(self.matrices)
        every = None
        for n in names:
            part = self.matrices[n].withColumn("mat", F.lit(n))
            every = part if every is None else every.unionByName(part)
        return overlay_matrices(every, names)

    def seed(self, rows: str | DataFrame = "kmeans", cols: str | DataFrame = "best") -> "BiclusterRun":
        """Start memberships: a method name or given members (k, id)."""
        s = self.settings
        if s.custom_seed is not None:
            rows, cols = s.custom_seed(self)
        m = self.overlay()
        if isinstance(rows, DataFrame):
            got = rows
        elif rows == "kmeans":
            got = sd.seed_kmeans(m, s.n_clusters, seed=s.seed)
        elif rows == "random":
            got = sd.seed_random(self.rows, s.n_clusters, s.per_row, s.seed)
        elif rows.startswith("random="):
            got = sd.seed_random_n(self.rows, s.n_clusters, int(rows.split("=")[1]), s.per_row, s.seed)
        elif rows.startswith("cor="):
            got = sd.seed_correlated(m, s.n_clusters, int(rows.split("=")[1]), s.seed)
        elif rows.startswith("net="):
            name, size = rows[4:].split(":")
            got = sd.seed_network(self.networks[name], s.n_clusters, int(size), s.seed)
        elif rows.startswith("netcor="):
            name, size = rows[7:].split(":")
            got = sd.seed_correlated(m, s.n_clusters, int(size), s.seed, self.networks[name])
        elif rows.startswith("trimkmeans="):
            got = sd.seed_trimmed_kmeans(m, s.n_clusters, float(rows.split("=")[1]), seed=s.seed).where("k > 0")
        else:
            raise ValueError(f"unknown row seeding {rows}")
        self.row_member = materialize(got.select(F.col("k").cast("int").alias("k"), "row_id").distinct(), "members")
        if self.per_col >= s.n_clusters:
            picked = self.cols.select(F.explode(F.sequence(F.lit(1), F.lit(s.n_clusters))).alias("k"), "col_id")
        elif isinstance(cols, DataFrame):
            picked = cols
        else:
            picked = sd.seed_columns(m, self.row_member, self.per_col, "best" if cols == "best" else "rnd", s.n_clusters, s.seed)
        self.col_member = materialize(picked.select(F.col("k").cast("int").alias("k"), "col_id").distinct(), "members")
        return self

    def row_scores(self) -> DataFrame:
        parts = {}
        for n, m in self.matrices.items():
            if not self.row_weights.get(n):
                continue
            if self.settings.col_weights is not None:
                raw = sc.row_scores(m, self.row_member, self.col_member, self.settings.col_weights(m, self.row_member, self.col_member))
                full = sc.complete(raw, self.vectors[n], self.ks)
            else:
                full = sc.row_scores_packed(self.vectors[n], self.axes[n], m, self.row_member, self.col_member, self.settings.n_clusters)
            parts[n] = (sc.fill_with_member_quantile(materialize(full, "scores"), self.row_member), self.row_weights[n])
        return sc.weighted_sum(parts) if len(parts) > 1 else next(iter(parts.values()))[0]

    def col_scores(self) -> DataFrame:
        parts = {}
        for n, m in self.matrices.items():
            if self.row_weights.get(n):
                per_row = self.settings.member_weights(m, self.row_member, self.col_member) if self.settings.member_weights else None
                full = sc.complete(sc.col_scores(m, self.row_member, row_weights=per_row), self.axes[n], self.ks, "col_id")
                parts[n] = (sc.fill_with_member_quantile(materialize(full, "scores"), self.col_member, "col_id"), self.row_weights[n])
        return sc.weighted_sum(parts, "col_id") if len(parts) > 1 else next(iter(parts.values()))[0]

    def net_scores(self) -> DataFrame | None:
        combine = self.settings.net_combine or F.sum
        parts = {n: (sc.network_scores(e, self.row_member, combine), self.net_weights.get(n, 0.0)) for n, e in self.networks.items()}
        if self.groups is not None and self.net_weights.get("groups"):
            parts["groups"] = (sc.group_network_scores(self.group_edges(), self.row_member, max(2, self.n_rows // 20)), self.net_weights["groups"])
        if not any(w for _, w in parts.values()):
            return None
        return sc.weighted_sum(parts).join(self.rows, "row_id", "left_semi")

    def group_edges(self) -> DataFrame:
        """The grouping with its weights scaled so that the network it stands for weighs as much as the heaviest network."""
        if self.scaled_groups is None:
            own = nw.group_network_degrees(self.groups, max(2, self.n_rows // 20)).agg(F.sum("weight").alias("s")).first()["s"]
            tops = [e.agg(F.sum("weight").alias("s")).first()["s"] or 0.0 for e in self.networks.values()]
            factor = max(tops) / own if tops and own and max(tops) > 0 else 1.0
            self.scaled_groups = materialize(self.groups.withColumn("weight", F.col("weight") * F.lit(float(factor))), "groups")
        return self.scaled_groups

    def refresh_scores(self, it: int, force: bool = False) -> None:
        """Recompute the families scheduled for this iteration; the others keep their written table."""
        s = self.settings
        if force or self.row is None or s.rows_on(it):
            self.row = materialize(self.row_scores(), "row_scores")
        if self.per_col < s.n_clusters and (force or self.col is None or s.cols_on(it)):
            self.col = materialize(self.col_scores(), "col_scores")
        if self.motifs is not None and s.mot_weight and s.search_on(it):
            self.hits = self.motifs.search(self.row_member)
        if self.hits is not None and (force or s.motifs_on(it)):
            self.mot = materialize(sc.motif_scores(self.hits, self.row_member).withColumn("score", F.col("score") * s.mot_weight), "mot_scores")
        if (self.networks or self.groups is not None) and (force or self.net is None or s.nets_on(it)):
            net = self.net_scores()
            self.net = materialize(net, "net_scores") if net is not None else None

    def next_rows(self, it: int) -> DataFrame:
        s = self.settings
        r = cb.combine_scores(self.row, self.row_member, self.mot, self.net, s.scaling(it))
        if s.fuzz(it) > 1e-5:
            r = materialize(cb.fuzz(r, self.row_member, s.fuzz(it), it, s.seed), "combined")
        rr = cb.density_scores(r, self.row_member, has_other=self.col_member)
        rr = materialize(cb.size_compensation(rr, self.row_member, "row_id", self.n_rows, s.per_row, s.n_clusters, s.rows_allowed[0]), "density")
        slots = mb.membership_slots(self.row_member, self.rows, s.per_row)
        return materialize(mb.slots_to_members(mb.update_membership(rr, slots, s.per_row, s.max_change_rows, it, s.seed)), "members")

    def next_cols(self, it: int) -> DataFrame:
        s = self.settings
        if self.col is None:
            return self.col_member
        c = cb.floor_low(self.col, "score")
        if s.fuzzy_cols > 1e-5:
            c = materialize(cb.fuzz(c, self.col_member, s.fuzzy_cols, it, s.seed + 1, "col_id"), "combined")
        cc = cb.density_scores(c, self.col_member, "col_id", rows=False, has_other=self.row_member)
        cc = materialize(cb.size_compensation(cc, self.col_member, "col_id", self.n_cols, self.per_col, s.n_clusters, self.n_cols / 10), "density")
        slots = mb.membership_slots(self.col_member, self.cols, self.per_col, "col_id")
        return materialize(mb.slots_to_members(mb.update_membership(cc, slots, self.per_col, s.max_change_cols, it, s.seed + 1, "col_id"), "col_id"), "members")

    def step(self) -> "BiclusterRun":
        """One iteration; tables that neither the new state nor the statistics read are dropped behind it."""
        with recorded() as made:
            self.iterate()
        self.scratch = drop_unused(self.spark, self.scratch + made, self.frames())
        return self

    def frames(self) -> list[DataFrame]:
        own = [getattr(self, f) for f in self.STATE.values()] + [self.scaled_groups, *self.stats]
        if self.motifs is not None:
            own += [getattr(self.motifs, f) for f in self.MOTIFS.values()]
        return [df for df in own if df is not None]

    def iterate(self) -> "BiclusterRun":
        """Rows and columns depend only on the scores, so both updates run side by side."""
        s, it = self.settings, self.iteration + 1
        self.refresh_scores(it)
        with ThreadPoolExecutor(2) as pool:
            rows = pool.submit(inheritable_thread_target(self.spark)(self.next_rows), it)
            cols = pool.submit(inheritable_thread_target(self.spark)(self.next_cols), it)
            self.row_member, self.col_member = rows.result(), cols.result()
        if s.merge_every and it % s.merge_every == 0:
            self.merge_and_reseed(it)
        self.iteration = it
        if s.post_adjust and it == s.n_iter:
            self.adjust()
        if it % s.stats_every == 0 or it == s.n_iter:
            self.stats.append(materialize(self.statistics(), "stats"))
        if s.on_iteration is not None:
            s.on_iteration(self)
        return self

    def run(self, n: int | None = None) -> "BiclusterRun":
        if self.row_member is None:
            self.seed()
        for _ in range(n if n is not None else self.settings.n_iter - self.iteration):
            self.step()
        return self

    def merge_and_reseed(self, it: int) -> None:
        """Fold near-equal clusters into one and restart what is left empty: rows by correlation, columns at random."""
        s, m = self.settings, self.overlay()
        merged, _ = mb.merge_duplicates(self.row, self.row_member, cutoff=s.merge_cutoff)
        merged = materialize(merged, "members")
        self.row_member = materialize(mb.reseed_small(m, merged, self.ks, *s.rows_allowed, 2 * s.rows_allowed[0], it, s.seed), "members")
        emptied = self.col_member.join(self.row_member.select("k").distinct(), "k", "left_semi")
        self.col_member = materialize(mb.reseed_columns(m, emptied, self.ks, iteration=it, seed=s.seed), "members")

    def adjust(self) -> None:
        """Final pass: adjust every cluster's rows on the combined scores, then score the new members."""
        self.refresh_scores(self.iteration, force=True)
        total = materialize(cb.combine_scores(self.row, self.row_member, self.mot, self.net, self.settings.scaling(max(1, self.iteration))), "adjust")
        self.row_member = materialize(mb.adjust_all(total, self.row_member, expand_only=False, max_rows=self.settings.rows_allowed[1]), "members")
        self.refresh_scores(self.iteration, force=True)

    def table(self) -> DataFrame:
        return cl.cluster_table(self.overlay(), self.row_member, self.col_member, self.hits, self.motifs.motifs if self.motifs else None)

    def statistics(self) -> DataFrame:
        col = self.col if self.col is not None else self.col_scores()
        return cl.run_stats(self.iteration, self.row, self.row_member, col, self.col_member, self.table(), self.mot, self.net)

    def stats_table(self) -> DataFrame:
        out = self.stats[0]
        for df in self.stats[1:]:
            out = out.unionByName(df)
        return out

    def summary(self) -> DataFrame:
        res = cl.residual(self.overlay(), self.row_member, self.col_member)
        cons = None
        if self.motifs is not None and self.motifs.pssm is not None:
            cons = mo.consensus(self.motifs.pssm).join(self.motifs.motifs.select("k", "mot", "e_value"), ["k", "mot"])
        out = cl.cluster_summary(self.row, self.row_member, res, self.mot, self.net, self.settings.scaling(max(1, self.iteration)), cons)
        return cl.size_adjusted_score(out, nrow_cutoff=None)

    def members_of(self, k: int, axis: str = "row_id") -> DataFrame:
        df = self.row_member if axis == "row_id" else self.col_member
        return df.where(F.col("k") == k)

    STATE = {"row_member": "row_member", "col_member": "col_member", "row_score": "row", "col_score": "col", "mot_score": "mot", "net_score": "net", "hits": "hits"}
    MOTIFS = {"motif": "motifs", "motif_pssm": "pssm", "motif_hits": "hits", "motif_members": "members"}

    def save(self, path: str) -> str:
        """Everything the next iteration reads: members, all score families, motif state, and the statistics so far."""
        tables = {name: df for name, field in self.STATE.items() if (df := getattr(self, field)) is not None}
        if self.motifs is not None:
            tables |= {name: df for name, field in self.MOTIFS.items() if (df := getattr(self.motifs, field)) is not None}
        if self.stats:
            tables["stats"] = self.stats_table()
        return writers.save_snapshot(tables, path, self.iteration)

    def resume(self, path: str, iteration: int) -> "BiclusterRun":
        """Go on from ``save``: the run continues as if it had not stopped. Matrices, networks and settings are given anew."""
        root = f"{path}/iter={iteration}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(root)
        listed = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(hadoop)
        there = {f.getPath().getName() for f in listed}
        for name, field in self.STATE.items():
            setattr(self, field, self.spark.read.parquet(f"{root}/{name}") if name in there else None)
        if self.motifs is not None:
            for name, field in self.MOTIFS.items():
                setattr(self.motifs, field, self.spark.read.parquet(f"{root}/{name}") if name in there else None)
        self.stats = [self.spark.read.parquet(f"{root}/stats")] if "stats" in there else []
        self.iteration = iteration
        return self

    def export(self, path: str, genome: Mapping[str, DataFrame] | None = None) -> list[str]:
        """Every exported table of the run that exists; ``genome`` adds the caller's own under the names of ``GENOME``."""
        genome = dict(genome or {})
        if unknown := sorted(set(genome) - set(self.GENOME)):
            raise ValueError(f"not genome tables: {unknown}")
        tabs = {
            "params": self.spark.createDataFrame([(k, str(v)) for k, v in vars(self.settings).items()], "name string, value string"),
            "ratios": self.overlay(), "bicluster": self.table(), "bicluster_genes": self.row_member, "bicluster_conds": self.col_member,
        }
        if self.stats:
            tabs["stats"] = self.stats_table()
        for n, e in self.networks.items():
            tabs[f"{n}_network"] = e
        if self.motifs is not None and self.motifs.motifs is not None:
            tabs |= {"motif": self.motifs.motifs, "motif_pssm": self.motifs.pssm, "motif_mast_posn": self.motifs.hits, "upstream_seqs": self.motifs.seqs}
            tabs["motif_meme_posn"] = self.motifs.sites(self.row_member)
        return writers.export_run(tabs | genome, path)


class SamplingRun(BiclusterRun):
    """The second optimizer: members are sampled from ECDF densities at a falling temperature."""

    max_rows, max_cols = 5, 10
    row_power, col_power = 8.0, 2.0

    def temperature(self, it: int) -> float:
        n = max(self.settings.n_iter, 2)
        return 0.15 - 0.10 * (min(it, n) - 1) / (n - 1)

    def iterate(self) -> "SamplingRun":
        s, it = self.settings, self.iteration + 1
        self.refresh_scores(it)
        w = s.scaling(it)
        parts = [(self.row, w[0]), (self.mot, w[1]), (self.net, w[2])]
        probs, total = None, sum(x for d, x in parts if d is not None)
        for df, x in parts:
            if df is None:
                continue
            full = df if df is self.row else self.row.select("row_id", "k").join(df, ["row_id", "k"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
            e = cb.ecdf_density(full, self.row_member).select("k", "row_id", (F.col("score") * (x / total)).alias("score"))
            probs = e if probs is None else probs.unionByName(e)
        probs = materialize(probs.groupBy("k", "row_id").agg(F.sum("score").alias("score")), "probs")
        temp = self.temperature(it)
        rows = materialize(mb.sample_members(probs, self.row_member, s.per_row, s.n_clusters, temp, self.max_rows, self.row_power, it, s.seed), "members")
        if self.col is not None:
            cp = materialize(cb.ecdf_density(self.col, self.col_member, axis="col_id"), "probs")
            self.col_member = materialize(mb.sample_members(cp, self.col_member, self.per_col, s.n_clusters, temp, self.max_cols, self.col_power, it, s.seed + 1, "col_id", final=it >= s.n_iter), "members")
        self.row_member, self.iteration = rows, it
        if it % s.stats_every == 0 or it == s.n_iter:
            self.stats.append(materialize(self.statistics(), "stats"))
        if s.on_iteration is not None:
            s.on_iteration(self)
        return self


def biclust(spark: SparkSession, matrices: Mapping[str, DataFrame], settings: Settings, n_iter: int | None = None, seed_rows: str | DataFrame = "kmeans", on_start: Callable[[BiclusterRun], None] | None = None, **inputs) -> BiclusterRun:
    """Initialise, seed and iterate; the whole run in one call."""
    run = BiclusterRun(spark, matrices, settings, **inputs).seed(seed_rows)
    if on_start is not None:
        on_start(run)
    return run.run(n_iter)


def numbered(member: DataFrame) -> DataFrame:
    """Renumber clusters 1..K without gaps."""
    order = indexed(member.select("k").distinct(), [], ["k"], "n")
    return member.join(order, "k").drop("k").withColumnRenamed("n", "k")
