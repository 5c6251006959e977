"""Splits that keep related records together (problem 3).

Grouped iterative stratification. Records and the entities they share form a graph; its connected components are the
units of the split. Each component has a label vector (records by label) and a home, the rarest of its labels in the
corpus. Labels are placed in order, rarest first; of a label's components the larger ones first, each into the split
that then needs that label most, of those that still lack half its records or more in all. Components with other labels too count against the needs of those as well.

Scale: components are found by alternating large-star and small-star steps with partial aggregates, each round
written to the shared folder. The greedy runs over groups of components of one home and one size, whose number is
bounded by the square root of the records (k different sizes make k * (k + 1) / 2 records), and places a group at once
by the level that its needs sink to, which gives the same as one by one. Nothing is rounded at any size. Where a home
has components with several labels, one aggregate brings their exact sums to the driver, a row for each split and label.
Components are numbered by ranges of home, size and hash, so neither a home nor a group gathers in one task.

Defined results. Records with a null entity are units of their own kind and stay out of the graph (their page is its
own component). Names that differ only in spelling are one entity. A null label is the label ''. Repeated rows count
once per distinct page. Ties go to the split that needs most records, then to the first split. A volume listed under
several sources has the first of them by name. An empty table gives an empty assignment. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.functions.names import fold_name, volume_of
from docflow.operators.records import positions
from docflow.session import materialise, pick

SPLITS = (("train", 0.81), ("val", 0.09), ("test", 0.10))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the graph with edges (a, b); a node without other edges has an edge to itself."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    links = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    checksum = lambda: tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    state = checksum()  # of stars with their smallest nodes as centres, one round tells that they are done
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("v"), "m").where("v <> m").union(least.select("a", "m")).distinct()
        links = materialise(small.select(F.col("v").alias("a"), F.col("m").alias("b")), "links")
        found = checksum()
        if found == state:
            break
        state = found
    return nodes.join(links.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def label_vectors(records: DataFrame, group: list[str], label: str) -> DataFrame:
    """group columns and labels: a map from each label of the group's records to their number. Partial sums go first."""
    counts = records.groupBy(*group, F.coalesce(F.col(label), F.lit("")).alias("label")).agg(F.count("*").alias("n"))
    return counts.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"))


def parted(vectors: DataFrame) -> DataFrame:
    """Groups whose records have more than one label, here the split that lists them."""
    return vectors.where(F.size("labels") > 1).drop("labels")


def shares(need: list[float], whole: list[float], size: int, count: int) -> list[int]:
    """How many of `count` components of `size` records each split gets if they go one by one to the split that needs the label most.

    A split takes part while it lacks at least half a component of all records; when none does, the rest go to those that
    lack most records. Either way needs sink to one level: what a split takes above it is known at once, and only the
    last few are placed singly.
    """
    room = [max(0, int(w / size + 0.5)) for w in whole]
    taken = _levelled(need, whole, size, min(count, sum(room)), room)
    left = [w - size * k for w, k in zip(whole, taken, strict=True)]
    rest = count - sum(taken)
    return [a + b for a, b in zip(taken, _levelled(left, left, size, rest, [rest] * len(left)), strict=True)]


def _levelled(need: list[float], ties: list[float], size: int, count: int, room: list[int]) -> list[int]:
    """How many of `count` each split gets, no more than its room, if they go one by one to the greatest need, then to the greater of ties, then to the first."""
    level = lambda t: [min(r, max(0, int((n - t) // size) + 1) if n > t else 0) for n, r in zip(need, room, strict=True)]
    low, high = min(need) - size * (count + 1.0), max(need)
    for _ in range(200):
        middle = (low + high) / 2
        if sum(level(middle)) > count - min(count, len(need)):
            low = middle
        else:
            high = middle
        if high - low <= size * 1e-6:
            break
    taken = level(high)
    for _ in range(count - sum(taken)):
        s = min((i for i in range(len(need)) if taken[i] < room[i]), key=lambda i: (size * taken[i] - need[i], size * taken[i] - ties[i], i))
        taken[s] += 1
    return taken


def stratify(units: DataFrame, splits: tuple[tuple[str, float], ...] = SPLITS) -> DataFrame:
    """component, split for units (component, labels)."""
    spark = units.sparkSession
    entries = materialise(units.select("component", F.explode("labels").alias("label", "n")), "entries")
    totals = {r["label"]: r["n"] for r in entries.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # a row a label
    if not totals:
        return units.select("component", F.lit(None).cast("string").alias("split")).limit(0)
    ranks = materialise(spark.createDataFrame([(label, rank) for rank, label in enumerate(sorted(totals, key=lambda x: (totals[x], x)))], "label string, rank int"), "ranks")
    homes = entries.join(ranks, "label").groupBy("component").agg(F.min(F.struct("rank", "label", "n")).alias("home"), F.count("*").alias("n_labels"))
    homes = homes.select("component", F.col("home.rank").alias("rank"), F.col("home.label").alias("home"), F.col("home.n").alias("size"), "n_labels", (-F.col("home.n")).alias("largest"), F.xxhash64(F.lit("rank"), "component").alias("h"))
    ranked = materialise(positions(homes, ["rank", "largest", "h", "component"]).select("component", "home", "size", "n_labels", "index"), "ranked")
    # A row for each home and size.
    groups = ranked.groupBy("home", "size").agg(F.count("*").alias("n"), F.min("index").alias("first"), F.count_if(F.col("n_labels") > 1).alias("several")).collect()
    by_home: dict[str, list] = {}
    for r in sorted(groups, key=lambda r: r["first"]):
        by_home.setdefault(r["home"], []).append(r)
    need = {label: [ratio * n for _, ratio in splits] for label, n in totals.items()}
    whole = [ratio * sum(totals.values()) for _, ratio in splits]
    schema, spans = "home string, size bigint, low bigint, high bigint, split string", []
    for label, own in by_home.items():
        placed = []
        for r in own:
            low = r["first"]
            for s, n in enumerate(shares(need[label], whole, r["size"], r["n"])):
                if n:
                    placed.append((label, r["size"], low, low + n, splits[s][0]))
                    need[label][s] -= n * r["size"]
                    whole[s] -= n * r["size"]
                    low += n
        spans += placed
        if any(r["several"] for r in own):
            several = _split_of(ranked.where((F.col("home") == label) & (F.col("n_labels") > 1)), spark.createDataFrame(placed, schema))
            others = several.join(entries.where(F.col("label") != label), "component").groupBy("split", "label").agg(F.sum("n").alias("n"))
            at = {name: s for s, (name, _) in enumerate(splits)}
            for r in others.collect():  # a row for each split and label
                need[r["label"]][at[r["split"]]] -= r["n"]
                whole[at[r["split"]]] -= r["n"]
    return _split_of(ranked, materialise(spark.createDataFrame(spans, schema), "spans")).select("component", "split")


def _split_of(ranked: DataFrame, spans: DataFrame) -> DataFrame:
    """component, split by the span of its group in which its number lies."""
    listed = spans.groupBy("home", "size").agg(F.collect_list(F.struct("low", "high", "split")).alias("spans"))
    inside = F.filter("spans", lambda s: (s["low"] <= F.col("index")) & (F.col("index") < s["high"]))
    return ranked.join(listed, ["home", "size"]).select("component", inside[0]["split"].alias("split"))


def manifest_pages(manifests: DataFrame) -> DataFrame:
    """scheme, split, page (folded name) and volume (folded name) of every listed image."""
    manifests = pick(manifests, "scheme", "train", "val", "test")
    lists = [manifests.select("scheme", F.lit(s).alias("split"), F.explode(s).alias("name")) for s in ("train", "val", "test")]
    listed = lists[0].union(lists[1]).union(lists[2]).where("name is not null")
    return listed.select("scheme", "split", fold_name(F.col("name")).alias("page")).select("*", volume_of(F.col("page")).alias("volume"))


def parted_volumes(manifests: DataFrame, volumes: DataFrame) -> DataFrame:
    """scheme, volume_id of the volumes that the manifests part: the audit of an assignment by the operator's units.

    Listed pages and their volumes form the graph, a scheme apart from another; components whose records have several
    splits as labels are parted ones, and of their volumes those count whose own records do.
    """
    known = pick(volumes, "volume_id", "img_volume").select("volume_id", volume_of(fold_name(F.col("img_volume"))).alias("volume")).where("volume is not null")
    listed = manifest_pages(manifests).where("volume is not null").withColumn("under", F.coalesce(F.concat(F.lit("s:"), "scheme"), F.lit("-")))
    listed = materialise(listed.select("scheme", "split", F.concat_ws("/", F.lit("p"), "under", "page").alias("page"), F.concat_ws("/", F.lit("a"), "under", "volume").alias("node"), "volume").distinct(), "listed")
    members = listed.join(components(listed.select(F.col("page").alias("a"), F.col("node").alias("b"))), "node")
    vectors = parted(label_vectors(members, ["component"], "split"))
    own = parted(label_vectors(members.join(vectors, "component"), ["scheme", "volume"], "split"))
    return own.join(known, "volume").select("scheme", "volume_id")


def assign(samples: DataFrame, manifests: DataFrame, volumes: DataFrame, splits: tuple[tuple[str, float], ...] = SPLITS) -> DataFrame:
    """page, volume, component, source, split of every page in samples and manifests. A volume is never parted.

    A page's volume is that of its name, else of img_volume; where both speak of different volumes they fall into one component.
    """
    samples, volumes = pick(samples, "img_filename", "img_volume"), pick(volumes, "img_volume", "source")
    named = samples.select(fold_name(F.col("img_filename")).alias("page"), fold_name(F.col("img_volume")).alias("given"))
    named = named.select("page", F.explode(F.array(volume_of(F.col("page")), F.col("given"))).alias("volume")).where("volume is not null")
    pages = samples.select(fold_name(F.col("img_filename")).alias("page")).where("page is not null").select("page", F.lit(None).cast("string").alias("volume"))
    listed = manifest_pages(manifests).select(F.regexp_replace("page", "_(jpe?g|png|tiff?)$", "").alias("page"), "volume")
    every = named.union(pages).union(listed).select(F.regexp_replace("page", "_(jpe?g|png|tiff?)$", "").alias("page"), "volume").distinct()
    every = materialise(every, "pages")
    edges = every.select(F.concat(F.lit("p:"), "page").alias("a"), F.coalesce(F.concat(F.lit("a:"), "volume"), F.concat(F.lit("p:"), "page")).alias("b"))
    found = components(edges)
    of_page = found.where(F.col("node").startswith("p:")).select(F.substring("node", 3, 1 << 20).alias("page"), "component")
    sources = volumes.select(fold_name(F.col("img_volume")).alias("volume"), "source").groupBy("volume").agg(F.min("source").alias("source"))
    main = every.groupBy("page").agg(F.min("volume").alias("volume"))
    full = materialise(main.join(of_page, "page").join(sources, "volume", "left"), "full")
    split = stratify(label_vectors(full, ["component"], "source"), splits)
    return full.join(split, "component").select("page", "volume", "component", "source", "split")
