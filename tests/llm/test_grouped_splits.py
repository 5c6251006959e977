from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from docflow.llm import grouped_splits as S


def test_components_against_brute_force(spark) -> None:
    rng = random.Random(2)
    nodes = [f"n{k:03d}" for k in range(120)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(90)] + [("chain%02d" % k, "chain%02d" % (k + 1)) for k in range(40)]
    root: dict[str, str] = {}

    def find(x: str) -> str:
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["component"] for r in S.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: find(n) for e in edges for n in e}


def one_by_one(need: list[float], whole: list[float], size: int, count: int) -> list[int]:
    need, whole, taken = list(need), list(whole), [0] * len(need)
    for _ in range(count):
        open_ = [i for i in range(len(need)) if whole[i] >= size / 2]
        s = min(open_, key=lambda i: (-need[i], -whole[i], i)) if open_ else min(range(len(need)), key=lambda i: (-whole[i], i))
        taken[s], need[s], whole[s] = taken[s] + 1, need[s] - size, whole[s] - size
    return taken


def test_shares_are_those_of_placing_one_by_one() -> None:
    rng = random.Random(6)
    for _ in range(500):
        n = rng.choice([1, 2, 3, 3, 5])
        need, whole = [rng.choice([rng.uniform(-50, 900), rng.randint(-5, 50)]) for _ in range(n)], [rng.choice([rng.randint(-9, 99), rng.randint(0, 9999)]) for _ in range(n)]
        size, count = rng.randint(1, 60), rng.choice([0, 1, 2, rng.randint(0, 300)])
        assert S.shares(need, whole, size, count) == one_by_one(need, whole, size, count)
    assert sum(S.shares([8.1e11, 0.9e11, 1e11], [8.1e11, 0.9e11, 1e11], 1, 10**12)) == sum(S.shares([8.1e11, 0.9e11, 1e11], [0, 0, 0], 1, 10**12)) == 10**12


def test_stratified_against_placing_one_by_one(spark) -> None:
    """Components of up to three of nine labels, each size apart, against the rule spelled out; and far more label vectors than groups."""
    rng = random.Random(14)
    labels = [f"l{k}" for k in range(9)]
    units = [(f"c{k:05d}", {x: rng.choice([1, 1, 2, 5, rng.randint(1, 400)]) for x in rng.sample(labels, rng.choice([1, 1, 2, 3]))}) for k in range(3000)]
    frame = spark.createDataFrame(units, "component string, labels map<string,bigint>")
    h = {r["component"]: r["h"] for r in frame.select("component", F.xxhash64(F.lit("rank"), "component").alias("h")).collect()}
    totals = defaultdict(int)
    for _, vector in units:
        for label, n in vector.items():
            totals[label] += n
    order = {label: k for k, label in enumerate(sorted(totals, key=lambda x: (totals[x], x)))}
    need = {label: [r * n for _, r in S.SPLITS] for label, n in totals.items()}
    whole = [r * sum(totals.values()) for _, r in S.SPLITS]
    groups = defaultdict(list)
    for c, vector in units:
        home = min(vector, key=order.get)
        groups[order[home], -vector[home], home].append((h[c], c, vector))
    want = {}
    for (_, size, home), members in sorted(groups.items()):
        taken = one_by_one(need[home], whole, -size, len(members))
        for (_, c, vector), s in zip(sorted(members, key=lambda m: m[:2]), [s for s, n in enumerate(taken) for _ in range(n)], strict=True):
            want[c] = S.SPLITS[s][0]
            for label, n in vector.items():
                if label == home:
                    need[label][s] -= n
                    whole[s] -= n
        own = [g for g in groups if g[2] == home]
        if (order[home], size) == max(g[:2] for g in own):  # the home is done: its components' other labels count
            for g in own:
                for _, c, vector in groups[g]:
                    s = [x for x, _ in S.SPLITS].index(want[c])
                    for label, n in vector.items():
                        if label != home:
                            need[label][s] -= n
                            whole[s] -= n
    assert {r["component"]: r["split"] for r in S.stratify(frame).collect()} == want
    assert len({tuple(sorted(v.items())) for _, v in units}) > 2 * len(groups)


def tables(spark):
    rng = random.Random(8)
    pages = [(f"By_arkiv_A{v:07d}_{p:05d}", f"By_arkiv_A{v:07d}") for v in range(1, 80) for p in range(rng.randint(1, 30))] + [(f"By_arkiv_A0000999_{p:05d}", None) for p in range(200)]
    samples = spark.createDataFrame([(k, i, v, "x", "y") for k, (i, v) in enumerate(pages + pages[:50])] + [(9999, None, None, None, None), (9998, "IMG_5", None, None, None)], "sample_id long, img_filename string, img_volume string, split string, component string")
    volumes = spark.createDataFrame([(v, f"BY_ARKIV_a{v:07d}", "norr" if v % 3 else "syd") for v in [*range(1, 80), 999]], "volume_id long, img_volume string, source string")
    manifests = spark.createDataFrame(
        [("mixed", ["By_arkiv_A0000001_00001", None, "BY_ARKIV_A0000002_00001.jpg"], ["By_arkiv_A0000001_00002"], None, 1), ("mixed", None, [], ["by_arkiv_a0000002_00003", "Okand_X99999999_00001"], 1), ("sbs", ["By_arkiv_A0000001_00001", "Okand_X99999999_00002"], None, ["By_arkiv_A0000003_00001"], 1)],
        "scheme string, train array<string>, val array<string>, test array<string>, volume int",
    )
    return samples, manifests, volumes


def test_no_volume_is_parted(spark) -> None:
    got = S.assign(*tables(spark)).collect()
    of = defaultdict(set)
    for r in got:
        of[r["volume"] or r["page"]].add(r["split"])
    assert all(len(s) == 1 for s in of.values()) and len({r["page"] for r in got}) == len(got)
    n = defaultdict(int)
    for r in got:
        n[r["split"]] += 1
    assert all(abs(n[s] / len(got) - r) < 0.03 for s, r in S.SPLITS)


def test_parted_volumes(spark) -> None:
    _, manifests, volumes = tables(spark)
    assert sorted(map(tuple, S.parted_volumes(manifests, volumes).collect())) == [("mixed", 1), ("mixed", 2)]
    assert S.parted_volumes(manifests.where("false"), volumes).count() == 0
    assert S.parted_volumes(manifests.withColumn("scheme", F.when(F.col("scheme") != "mixed", F.col("scheme"))), volumes).where("scheme is null").count() == 2
    assert S.parted_volumes(manifests, volumes.where("false")).count() == 0


def test_empty(spark) -> None:
    samples, manifests, volumes = tables(spark)
    assert S.assign(samples.where("false"), manifests.where("false"), volumes).count() == 0
