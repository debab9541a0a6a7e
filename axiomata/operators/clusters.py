"""Community detection, cluster quality, and votes of members."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.stages import written
from . import cooccurrence
from .vectors import cosine

# --- communities -------------------------------------------------------------


def _neighbours(pdf: pd.DataFrame) -> tuple[list[int], list[dict[int, float]]]:
    """Node ids in order, and for each node its neighbours' weights by index."""
    ids = sorted(set(pdf["i"]) | set(pdf["j"]))
    at = {x: k for k, x in enumerate(ids)}
    near: list[dict[int, float]] = [{} for _ in ids]
    for i, j, w in zip(pdf["i"], pdf["j"], pdf["w"], strict=True):
        a, b = at[i], at[j]
        near[a][b] = near[a].get(b, 0.0) + w
        if a != b:
            near[b][a] = near[b].get(a, 0.0) + w
    return ids, near


def propagated(near: list[dict[int, float]], rounds: int = 50) -> list[int]:
    """G-13: labels by repeated majority of neighbours, in node order and at once; ties to the least label."""
    label = list(range(len(near)))
    for _ in range(rounds):
        stable = True
        for k, links in enumerate(near):
            if not links:
                continue
            votes: dict[int, float] = {}
            for other, w in sorted(links.items()):
                votes[label[other]] = votes.get(label[other], 0.0) + w
            winner = min(votes, key=lambda c: (-votes[c], c))
            if winner != label[k]:
                label[k], stable = winner, False
        if stable:
            break
    return label


def moved(near: list[dict[int, float]], size: list[float], resolution: float, modular: bool, whole: float) -> list[int]:
    """One level of G-14: each node goes to the community that gains most, until none moves.

    The cost of a community is its total degree (modularity) or size (constant
    Potts model); ``whole`` is twice the graph's weight.
    """
    degree = [sum(w for o, w in links.items() if o != k) + 2 * links.get(k, 0.0) for k, links in enumerate(near)]
    own = degree if modular else size
    scale = resolution / whole if modular else resolution
    home, load = list(range(len(near))), list(own)
    again = whole > 0
    while again:
        again = False
        for k, links in enumerate(near):
            pull: dict[int, float] = {home[k]: 0.0}
            for other, w in sorted(links.items()):
                if other != k:
                    pull[home[other]] = pull.get(home[other], 0.0) + w
            load[home[k]] -= own[k]
            gain = {c: w - scale * load[c] * own[k] for c, w in pull.items()}
            stay = gain[home[k]]
            best = min(gain, key=lambda c: (-gain[c], c))
            if gain[best] > stay or (gain[best] == stay and best < home[k]):
                home[k], again = best, True
            load[home[k]] += own[k]
    return home


def communities(near: list[dict[int, float]], resolution: float, modular: bool, whole: float | None = None, passes: int = 20) -> list[int]:
    """G-14: communities by moving nodes, then merging each community to a node, until nothing merges."""
    size = [1.0] * len(near)
    if whole is None:
        whole = sum(w * (2 if o == k else 1) for k, links in enumerate(near) for o, w in links.items())
    group = list(range(len(near)))
    for _ in range(passes):
        home = moved(near, size, resolution, modular, whole)
        number = {c: n for n, c in enumerate(dict.fromkeys(home))}
        if len(number) == len(near):
            break
        step = [number[c] for c in home]
        group = [step[c] for c in group]
        merged: list[dict[int, float]] = [{} for _ in number]
        sizes = [0.0] * len(number)
        for k, links in enumerate(near):
            sizes[step[k]] += size[k]
            for other, w in links.items():
                a, b = step[k], step[other]
                # an edge inside a community is seen from both ends, a loop once
                share = w / 2 if a == b and other != k else w
                merged[a][b] = merged[a].get(b, 0.0) + share
        near, size = merged, sizes
    return group


def detect(edges: DataFrame, method: str = "cpm", resolution: float = 0.1) -> DataFrame:
    """G-13, G-14: (node, community) of the nodes of (i, j, w), each community named by its least node.

    Nodes move one by one, so a connected component is worked in one task;
    components are independent of each other (for modularity through the whole
    graph's weight, which is passed in). A component must fit in a task.
    """
    base = written(edges.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("w").cast("double").alias("w")), "edges")
    whole = 2 * (base.agg(F.sum("w")).first()[0] or 0.0) if method == "louvain" else 0.0
    part = connected_components(base, "i", "j")
    parted = base.join(part.withColumnsRenamed({"node": "i"}), "i")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, near = _neighbours(pdf)
        found = propagated(near) if method == "lpa" else communities(near, resolution, method == "louvain", whole if method == "louvain" else None)
        least: dict[int, int] = {}
        for x, c in zip(ids, found, strict=True):
            least[c] = min(least.get(c, x), x)
        return pd.DataFrame({"node": ids, "community": [least[c] for c in found]})

    return parted.groupBy("component").applyInPandas(run, "node long, community long")


# --- quality -----------------------------------------------------------------


def modularity(edges: DataFrame, members: DataFrame, resolution: float = 1.0) -> DataFrame:
    """A-15: one row; edges (i, j, w) once each, members (node, community)."""
    a, b = members.toDF("i", "ci"), members.toDF("j", "cj")
    known = edges.join(a, "i").join(b, "j")
    ends = known.select(F.col("ci").alias("c"), "w").union(known.select("cj", "w"))
    total = ends.groupBy("c").agg(F.sum("w").alias("t"))
    inside = known.filter("ci = cj").groupBy(F.col("ci").alias("c")).agg((2 * F.sum("w")).alias("s"))
    whole = known.agg((2 * F.sum("w")).alias("m"))
    joined = total.join(inside, "c", "left").join(F.broadcast(whole))
    q = F.coalesce("s", F.lit(0.0)) / F.col("m") - resolution * F.pow(F.col("t") / F.col("m"), F.lit(2))
    return joined.agg(F.coalesce(F.sum(q), F.lit(0.0)).alias("modularity"))


def cpm_quality(edges: DataFrame, members: DataFrame, resolution: float = 0.1) -> DataFrame:
    """A-15: one row: weight inside communities less the resolution for each pair inside."""
    a, b = members.toDF("i", "ci"), members.toDF("j", "cj")
    inside = edges.join(a, "i").join(b, "j").filter("ci = cj").groupBy(F.col("ci").alias("community")).agg(F.sum("w").alias("s"))
    size = members.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    q = F.coalesce("s", F.lit(0.0)) - resolution * F.col("n") * (F.col("n") - 1) / 2
    return size.join(inside, "community", "left").agg(F.coalesce(F.sum(q), F.lit(0.0)).alias("quality"))


def nmi(rows: DataFrame, cluster: str, label: str) -> DataFrame:
    """A-13: (nmi, labelled) of the rows that have a label."""
    own = rows.select(F.col(cluster).alias("c"), F.col(label).alias("l")).filter("l is not null")
    joint = own.groupBy("c", "l").agg(F.count(F.lit(1)).alias("n"))
    pc = joint.groupBy("c").agg(F.sum("n").alias("nc"))
    pl = joint.groupBy("l").agg(F.sum("n").alias("nl"))
    total = joint.agg(F.sum("n").alias("t"))
    entropy = lambda df, n, name: df.join(F.broadcast(total)).agg(F.sum(-F.col(n) / F.col("t") * F.log(F.col(n) / F.col("t"))).alias(name))
    mutual = joint.join(pc, "c").join(pl, "l").join(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nc") * F.col("nl")))).alias("i"), F.first("t").alias("labelled"))
    # one row each
    out = mutual.join(F.broadcast(entropy(pc, "nc", "hc"))).join(F.broadcast(entropy(pl, "nl", "hl")))
    return out.select(F.when(F.col("hc") + F.col("hl") > 0, 2 * F.col("i") / (F.col("hc") + F.col("hl"))).otherwise(F.lit(0.0)).alias("nmi"), F.coalesce("labelled", F.lit(0)).alias("labelled"))


def purity(rows: DataFrame, cluster: str, label: str) -> DataFrame:
    """A-14: (purity, labelled)."""
    counts = rows.filter(F.col(label).isNotNull()).groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(cluster).agg(F.max("n").alias("m"), F.sum("n").alias("s"))
    return best.agg(F.coalesce(F.sum("m") / F.sum("s"), F.lit(0.0)).alias("purity"), F.coalesce(F.sum("s"), F.lit(0)).alias("labelled"))


def by_size(members: DataFrame) -> DataFrame:
    """O-04: (community, size, members), the largest first."""
    return members.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("node")).alias("members")).orderBy(F.desc("size"), "community")


# --- votes -------------------------------------------------------------------


def vote(rows: DataFrame, cluster: str, code: str) -> DataFrame:
    """A-12: (cluster, code, votes): the most frequent code of each cluster, ties to the least code."""
    counts = rows.filter(F.col(code).isNotNull()).groupBy(F.col(cluster).alias("cluster"), F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("votes"))
    return counts.withColumn("n", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("votes"), "code"))).filter("n = 1").drop("n")


def align(rows: DataFrame, cluster: str, section: str, top: str) -> DataFrame:
    """M-01: (cluster, size, grounded, code, confidence): the section that most members vote for, if more than half do, else the top level."""
    size = rows.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("size"), F.count(section).alias("grounded"))
    s, t = vote(rows, cluster, section).toDF("cluster", "s_code", "s_votes"), vote(rows, cluster, top).toDF("cluster", "t_code", "t_votes")
    joined = size.join(s, "cluster", "left").join(t, "cluster", "left")
    narrow = F.col("s_votes") / F.col("grounded") > 0.5
    return joined.select(
        "cluster",
        "size",
        "grounded",
        F.when(narrow, F.col("s_code").cast("string")).otherwise(F.col("t_code").cast("string")).alias("code"),
        F.when(F.col("grounded") == 0, F.lit(0.0)).when(narrow, F.col("s_votes") / F.col("grounded")).otherwise(F.col("t_votes") / F.col("grounded")).alias("confidence"),
    )


def confident() -> Column:
    return (F.col("grounded") >= 2) & (F.col("confidence") > 0.5)


def propagate(aligned: DataFrame, rows: DataFrame, ident: str, cluster: str, code: str) -> DataFrame:
    """M-02: (id, cluster, code, confidence) for members without a code in confident clusters."""
    own = rows.filter(F.col(code).isNull()).select(F.col(ident).alias("id"), F.col(cluster).alias("cluster"))
    return own.join(aligned.filter(confident()).select("cluster", "code", "confidence"), "cluster").select("id", "cluster", "code", "confidence")


def statuses(aligned: DataFrame, rows: DataFrame, ident: str, cluster: str) -> DataFrame:
    """M-03: (cluster, representative, status, code)."""
    least = rows.groupBy(F.col(cluster).alias("cluster")).agg(F.min(ident).alias("representative"))
    status = F.when(F.col("grounded") == 0, "unclassified").when(confident(), "classified").otherwise("pending")
    return aligned.join(least, "cluster").select("cluster", "representative", status.alias("status"), "code")


def relatedness(section_a: Column, top_a: Column, code_a: Column, section_b: Column, top_b: Column, code_b: Column) -> Column:
    """V-09: 1, 0.6 or 0.3 for the same code, section or top level, else 0."""
    return F.when(code_a == code_b, F.lit(1.0)).when(section_a == section_b, F.lit(0.6)).when(top_a == top_b, F.lit(0.3)).otherwise(F.lit(0.0))


def concept_graph(vectors: DataFrame, near: DataFrame, links: DataFrame, codes: DataFrame, min_cooccur: int = 3, w_embed: float = 1.0, w_cooccur: float = 0.5, w_code: float = 0.3) -> DataFrame:
    """V-10, G-12: (i, j, weight) of neighbours ``near`` (i, j) and of nodes that share enough documents, where the weight is positive.

    ``vectors``: (node, vector); ``links``: (g, x), documents and their nodes;
    ``codes``: (node, code, section, top). The weight is the sum of cosine,
    Jaccard of the documents and relatedness of the codes, each with its share.
    """
    inside = links.join(vectors.select(F.col("node").alias("x")), "x", "left_semi").select("g", "x")
    shared = written(cooccurrence.jaccard(cooccurrence.pairs(inside), inside), "shared")
    pairs = near.select("i", "j").union(shared.filter(F.col("n") >= min_cooccur).select("i", "j")).distinct()
    a, b = vectors.toDF("i", "vi"), vectors.toDF("j", "vj")
    ca, cb = codes.toDF("i", "ki", "si", "ti"), codes.toDF("j", "kj", "sj", "tj")
    joined = pairs.join(a, "i").join(b, "j").join(shared.select("i", "j", "jaccard"), ["i", "j"], "left").join(ca, "i", "left").join(cb, "j", "left")
    code = relatedness(F.col("si"), F.col("ti"), F.col("ki"), F.col("sj"), F.col("tj"), F.col("kj"))
    weight = w_embed * cosine(F.col("vi"), F.col("vj")) + w_cooccur * F.coalesce("jaccard", F.lit(0.0)) + w_code * code
    return joined.select("i", "j", weight.alias("weight")).filter("weight > 0")
