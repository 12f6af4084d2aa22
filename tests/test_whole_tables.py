"""Queries without SQL read all rows of their tables: by brute force on small tables with large ids."""

import heapq

import trackloom.queries as core


def write(spark, folder, name, rows, ddl):
    spark.createDataFrame(rows, ddl).write.parquet(f"{folder}/{name}.parquet")


def test_edges_from_all_ways(spark, tmp_path):
    lines = {5: [1, 2, 3, 4], 1999: [7, 8], 2000: [9, 2, 10], 700_000: [11, 3, 9, 12]}
    write(spark, tmp_path, "lineitem", [(o, i, p) for o, ps in lines.items() for i, p in enumerate(ps)], "l_orderkey long, l_linenumber int, l_partkey long")
    got = {(r["way"], r["part"], tuple(map(int, r["path"].split(",")))) for r in core.queries()["q_edges_from_ways"](spark, str(tmp_path)).collect()}
    want = {(5, 0, (1, 2)), (5, 1, (2, 3)), (5, 2, (3, 4)), (1999, 0, (7, 8)), (2000, 0, (9, 2)), (2000, 1, (2, 10)), (700_000, 0, (11, 3)), (700_000, 1, (3, 9)), (700_000, 2, (9, 12))}
    assert got == want


def test_route_grid_has_a_node_for_every_part(spark, tmp_path):
    n, wide = 500, 23
    sizes = {k: (k * k * 31 + k * 7) % 50 + 1 for k in range(n)}
    write(spark, tmp_path, "part", list(sizes.items()), "p_partkey long, p_size int")
    rows = core.queries()["q_route_grid"](spark, str(tmp_path)).collect()
    near = {k: [j for j in (k - wide, k + wide, *([k - 1] if k % wide else []), *([k + 1] if k % wide < wide - 1 else [])) if j in sizes and (sizes[k] + sizes[j]) % 7] for k in sizes}
    targets = (0, 20 * wide + 10, wide - 1)
    best, queue = {}, [(0, t) for t in targets]
    while queue:
        cost, k = heapq.heappop(queue)
        if k not in best:
            best[k] = cost
            for j in near[k]:
                heapq.heappush(queue, (cost + sizes[k] + sizes[j], j))
    assert {r["id"]: r["cost"] for r in rows} == {k: best.get(k) for k in sizes}
    for r in rows:
        if r["nodes"] is not None:
            path = r["nodes"]
            assert path[0] == r["id"] and path[-1] in targets and all(b in near[a] for a, b in zip(path, path[1:]))
            assert sum(sizes[a] + sizes[b] for a, b in zip(path, path[1:])) == r["cost"]
