"""Route search and candidates against brute force on small networks."""

import heapq
import itertools
import pathlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from fareflow.operators import routes, transfer

PENALTY = 180_000
LEG = "line", "f", "t", "i", "j", "ms", "lo", "hi", "total"


@pytest.fixture
def cut(tmp_path):
    def write(df):
        path = f"{tmp_path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return write


def tables(spark, lines, walks, change):
    """lines: name -> (nodes, seconds from stop to stop); walks: (f, t, seconds); change: node -> seconds."""
    stops = [(n, k, s) for n, (nodes, _) in lines.items() for k, s in enumerate(nodes)]
    rides = [(n, k + 1, float(x)) for n, (_, times) in lines.items() for k, x in enumerate(times)]
    frames = spark.createDataFrame(stops, "line string, pos int, node string"), spark.createDataFrame(rides, "line string, pos int, time double"), spark.createDataFrame(walks, "f string, t string, time double")
    return routes.route_legs(*frames), spark.createDataFrame(list(change.items()), "key string, transfer_time double")


def plain_legs(lines, walks):
    """(line, f, t, ms, passed nodes) of rides between any two places of a line, and walks."""
    out = []
    for line, (nodes, times) in lines.items():
        since = [0, *itertools.accumulate(round(1000 * x) for x in times)]
        loop = len(nodes) > 2 and nodes[0] == nodes[-1]
        for i, j in itertools.permutations(range(len(nodes)), 2):
            if nodes[i] != nodes[j] and (j > i or loop):
                passed = nodes[i + 1 : j + 1] if j > i else nodes[i + 1 :] + nodes[1 : j + 1]
                out.append((line, nodes[i], nodes[j], since[j] - since[i] if j > i else since[-1] - since[i] + since[j], passed))
    least = {}
    for f, t, x in walks:
        least[f, t] = min(least.get((f, t), 10**12), round(1000 * x))
    return out + [(None, f, t, ms, [t]) for (f, t), ms in least.items()]


def step(tag, weight, leg, change):
    line, f, _, ms, _ = leg
    if line is None:
        return "" if tag == "" else "*", weight + ms * 1_000_000 + 101
    if tag == line:
        return line, weight + ms * 1_000_000 + 1
    extra = 0 if tag == "" else PENALTY if tag == "*" else PENALTY + round(1000 * change[f])
    return line, weight + (ms + extra) * 1_000_000 + 10_001


def dijkstra(origin, legs, change):
    best, heap = {}, [(0, origin, "")]
    while heap:
        weight, node, tag = heapq.heappop(heap)
        if (node, tag) in best:
            continue
        best[node, tag] = weight
        for leg in legs:
            if leg[1] == node:
                to, w = step(tag, weight, leg, change)
                if (leg[2], to) not in best:
                    heapq.heappush(heap, (w, leg[2], to))
    out = {}
    for (node, _), w in best.items():
        out[node] = min(w, out.get(node, w))
    return out


def weight_of(path, change):
    tag, weight = "", 0
    for leg in path:
        tag, weight = step(tag, weight, (leg["line"], leg["f"], leg["t"], leg["ms"], None), change)
    return weight


def invented(seed, n=7, n_lines=5):
    rng = random.Random(seed)
    names = [f"subway:{k}" for k in range(n)]
    lines = {}
    for k in range(n_lines):
        nodes = rng.sample(names, rng.randint(2, 5))
        if k == 0 and len(nodes) > 2:
            nodes.append(nodes[0])
        lines[f"L{k}"] = (nodes, [rng.randint(1, 9) * 60 + rng.randint(0, 999) / 1000 for _ in nodes[1:]])
    walks = [(*rng.sample(names, 2), float(rng.randint(100, 900))) for _ in range(4)]
    return lines, walks, {x: float(rng.randint(0, 300)) for x in names}


@pytest.mark.parametrize("seed", [0, 2])
def test_search_is_dijkstra(spark, cut, seed):
    lines, walks, change = invented(seed)
    legs, stations = tables(spark, lines, walks, change)
    legs, plain = cut(legs), plain_legs(lines, walks)
    states = routes.search(stations, legs, stations, cut)
    got = {(r["origin"], r["node"]): r["w"] for r in states.groupBy("origin", "node").agg(F.min("weight").alias("w")).collect()}
    assert got == {(o, node): w for o in change for node, w in dijkstra(o, plain, change).items()}
    # with targets, dear states are left out, the targets' weights stay, and paths have the weight of their legs
    pairs = [(o, d) for o, d in itertools.permutations(change, 2) if (o, d) in got][::3]
    best = routes.shortest(spark.createDataFrame(pairs, "o_key string, d_key string"), legs, stations, cut)
    rows = {(r["o_key"], r["d_key"]): r for r in best.collect()}
    assert set(rows) == set(pairs)
    for (o, d), r in rows.items():
        path = r["path"]
        assert r["weight"] == got[o, d] == weight_of(path, change)
        assert path[0]["f"] == o and path[-1]["t"] == d and all(a["t"] == b["f"] for a, b in itertools.pairwise(path))
    # the cost of the path's edges, computed by another operator
    edges = routes.path_edges(best, F.concat_ws("~", "o_key", "d_key"))
    cost = {r["od"]: r["cost"] for r in routes.perceived_cost(edges, stations).collect()}
    assert all(abs(cost[f"{o}~{d}"] - r["weight"] // 1_000_000 / 1000) < 1e-6 for (o, d), r in rows.items())


def test_five_boardings(spark, cut):
    lines = {f"L{k}": ([f"subway:{k}", f"subway:{k + 1}"], [100.0]) for k in range(5)}
    legs, stations = tables(spark, lines, [("subway:9", "subway:9", 1.0)], {f"subway:{k}": 60.0 for k in range(6)})
    pairs = spark.createDataFrame([("subway:0", "subway:5"), ("subway:5", "subway:0")], "o_key string, d_key string")
    (row,) = routes.shortest(pairs, cut(legs), stations, cut).collect()
    parts = spark.createDataFrame([(row["weight"],)], "w long").select(*[c.alias(n) for n, c in routes.parts_of(F.col("w")).items()]).first()
    assert [leg["line"] for leg in row["path"]] == [f"L{k}" for k in range(5)]
    assert (parts["cost"], parts["boardings"], parts["walks"]) == (500.0 + 4 * 240, 5, 0)


def test_single_transfers_leave_out_walks_and_third_boardings(spark, cut):
    lines = {"A": (["subway:0", "subway:1"], [60.0]), "B": (["subway:1", "subway:2"], [60.0]), "C": (["subway:2", "subway:3"], [60.0]), "D": (["subway:4", "subway:5"], [60.0])}
    legs, stations = tables(spark, lines, [("subway:1", "subway:4", 30.0)], {f"subway:{k}": 100.0 for k in range(6)})
    pairs = spark.createDataFrame([("subway:0", "subway:2"), ("subway:0", "subway:3"), ("subway:0", "subway:5"), ("subway:0", "subway:1")], "o_key string, d_key string")
    got = transfer.single_transfer_od(routes.shortest(pairs, cut(legs), stations, cut)).collect()
    assert [tuple(r) for r in got] == [("subway:0", "subway:2", "A", "B", "subway:1", 120.0)]


def plain_lists(origin, legs, change, keep):
    """The documented lists, by dictionaries: a round adds a leg to each route that is new in a list."""
    lists, new = {(origin, ""): [(0, "", (), (origin,), ())]}, [(origin, "", (0, "", (), (origin,), ()))]
    while new:
        added = {}
        for node, tag, (weight, name, path, seen, lined) in new:
            for leg in legs:
                line, f, t, _, passed = leg
                if f == node and not set(passed) & set(seen) and len(set(passed)) == len(passed) and (line is None or line != tag):
                    to, w = step(tag, weight, leg, change)
                    label = w, ";".join(x for x in (name, f"{line or ''}>{t}") if x), (*path, leg), (*seen, *passed), (*lined, *((line,) if line else ()))
                    added.setdefault((t, to), []).append(label)
        new = []
        for state, labels in added.items():
            before, kept, lines = lists.get(state, []), [], set()
            for label in sorted([*before, *labels], key=lambda x: x[:2]):
                if label[4] not in lines:
                    lines.add(label[4])
                    kept.append(label)
            lists[state] = kept[:keep]
            new += [(*state, x) for x in lists[state] if x not in before]
    return lists


def edge_times(path, lines):
    out = {}
    for line, f, t, _, passed in path:
        if line:
            at = f
            for x in passed:
                nodes, times = lines[line]
                out[at, x, line] = next(round(1000 * sum(times[: k + 1])) - round(1000 * sum(times[:k])) for k in range(len(times)) if (nodes[k], nodes[k + 1]) == (at, x))
                at = x
    return out


def chosen(pool, lines, k=5):
    kept = []
    for label in sorted(pool, key=lambda x: x[:2]):
        mine = edge_times(label[2], lines)
        near = [edge_times(x[2], lines) for x in kept]
        if len(kept) < k and all(100 * sum(v for e, v in mine.items() if e in o) <= 80 * min(sum(mine.values()), sum(o.values())) for o in near):
            kept.append(label)
    return [x[1] for x in kept]


@pytest.mark.parametrize("seed", [11, 13])
def test_candidates_are_the_documented_ones(spark, cut, seed):
    lines, walks, change = invented(seed, 8, 6)
    legs, stations = tables(spark, lines, walks, change)
    legs, plain = cut(legs), plain_legs(lines, walks)
    fastest = {}
    for leg in plain:
        key = leg[:3]
        if key not in fastest or leg[3] < fastest[key][3]:
            fastest[key] = leg
    plain = list(fastest.values())
    pairs = list(itertools.permutations(change, 2))
    got = {}
    found = routes.candidates(spark.createDataFrame(pairs, "o_key string, d_key string"), legs, stations, cut, keep=3).withColumn("name", routes.named(F.col("path")))
    for r in found.collect():
        got.setdefault((r["o_key"], r["d_key"]), {})[r["rnk"]] = r
    several = looped = 0
    for o in change:
        lists, least = plain_lists(o, plain, change, 3), dijkstra(o, plain, change)
        for d in change:
            pool = [x for (node, _), labels in lists.items() if node == d for x in labels]
            rows = [r for _, r in sorted(got.get((o, d), {}).items())]
            assert (o, d) in got or d == o or d not in least
            if d == o or d not in least:
                continue
            assert [r["rnk"] for r in rows] == list(range(1, len(rows) + 1))
            weights = [r["weight"] for r in rows]
            assert weights == sorted(weights) and weights[0] == least[d] and all(weight_of(r["path"], change) == r["weight"] for r in rows)
            if pool and min(pool)[0] == least[d]:
                assert [r["name"] for r in rows] == chosen(pool, lines)
            else:
                looped += 1
            several += len(rows) > 1
    assert several > 5


def test_wrapped_rides_share_what_they_ride_together(spark):
    ride = lambda i, j, lo, hi: dict(zip(LEG, ("L", "a", "b", i, j, 0, lo, hi, 1000), strict=True))
    walk = dict.fromkeys(LEG) | {"f": "a", "t": "b", "ms": 5}
    schema = "k string, path array<struct<line: string, f: string, t: string, i: int, j: int, ms: bigint, lo: bigint, hi: bigint, total: bigint>>"
    rows = [("wrapped", [ride(8, 2, 800, 200)]), ("end", [ride(8, 9, 800, 900)]), ("begin", [walk, ride(0, 1, 0, 100)]), ("middle", [ride(3, 7, 300, 700)]), ("walk", [walk])]
    df = spark.createDataFrame(rows, schema).select("k", routes.ridden(F.col("path")).alias("s"))
    a = df.where("k = 'wrapped'").select(F.col("s").alias("w"))
    got = {r["k"]: r["ms"] for r in df.crossJoin(a).select("k", routes.shared_ms(F.col("s"), F.col("w")).alias("ms")).collect()}
    assert got == {"wrapped": 400, "end": 100, "begin": 100, "middle": 0, "walk": 0}


def test_no_pairs_and_unknown_stops(spark, cut):
    legs, stations = tables(spark, {"A": (["subway:0", "subway:1"], [60.0])}, [("x", "x", 1.0)], {"subway:0": 1.0, "subway:1": 1.0})
    pairs = spark.createDataFrame([("subway:0", "nowhere"), ("nowhere", "subway:1"), ("subway:0", "subway:0")], "o_key string, d_key string")
    assert routes.candidates(pairs, cut(legs), stations, cut).count() == 0
    assert routes.shortest(pairs.limit(0), legs, stations, cut).count() == 0


def test_a_merge_writes_only_folders_with_new_pairs(spark, tmp_path):
    path = str(tmp_path / "cache")
    route = lambda pairs: spark.createDataFrame([(o, d, 1, "A") for o, d in pairs], "o_key string, d_key string, rnk int, lines string")
    asked = lambda pairs: spark.createDataFrame(pairs, "o_key string, d_key string")
    first = [(f"o{k}", f"d{k}") for k in range(300)]
    routes.update_cache(path, route(first), asked([*first, ("o", "nowhere")]), slices=16)
    files = lambda: {p.parent.name: (p.name, p.stat().st_mtime_ns) for p in pathlib.Path(path).rglob("*.parquet")}
    before = files()
    assert len(before) == 16
    # a stored pair with another route stays, a new one comes, one is asked again
    spare = spark.createDataFrame([("o1", "d1", 7, "other"), ("x", "y", 1, "B")], "o_key string, d_key string, rnk int, lines string")
    merged = routes.update_cache(path, spare, asked([("x", "y"), ("o", "nowhere"), ("o2", "d2")]), slices=16)
    rows = {(r["o_key"], r["d_key"]): (r["rnk"], r["lines"]) for r in merged.collect()}
    assert rows == {**dict.fromkeys(first, (1, "A")), ("o", "nowhere"): (None, None), ("x", "y"): (1, "B")} and merged.count() == 302
    changed = {k for k, v in files().items() if before.get(k) != v}
    assert len(changed) == 1
    assert tuple(routes.cache_counts(merged).first()) == (302, 1)
    # nothing new: nothing is written
    after = files()
    routes.update_cache(path, spare, asked([("x", "y")]), slices=16)
    assert files() == after
