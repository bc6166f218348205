"""Inclusions between columns against sets in plain Python, with many columns and a fixed number of jobs."""
import random

from gridsight.operators import relational as r


def plain(tables):
    out = set()
    for ct, (cols, rows) in tables.items():
        for i, c in enumerate(cols):
            child = {x[i] for x in rows} - {None}
            for pt, (pcols, prows) in tables.items():
                for j, p in enumerate(pcols):
                    values = [x[j] for x in prows]
                    if ct != pt and child and child <= set(values) and type(next(iter(child))) is type(next(v for v in values if v is not None)):
                        out.add((ct, c, pt, p, len(set(values)) == len(values) and None not in values))
    return out


def frames(spark, tables, kinds):
    return {n: spark.createDataFrame(rows, ", ".join(f"`{c}` {kinds[n][i]}" for i, c in enumerate(cols))) for n, (cols, rows) in tables.items()}


def found(frame):
    return {tuple(x) for x in frame.collect()}


def test_inclusions_match_sets(spark):
    rng = random.Random(1)
    tables = {
        "parent": (["id", "code", "half"], [(i, f"k{i}", i // 2) for i in range(50)]),
        "child": (["parent_id", "code", "text id", "empty"], [(rng.choice([None, *range(50)]), f"k{rng.randrange(60)}", str(rng.randrange(50)), None) for _ in range(300)]),
        "holes": (["id", "v"], [(None, 1), (1, 2), (2, 3)]),
    }
    kinds = {"parent": ["long", "string", "int"], "child": ["int", "string", "string", "long"], "holes": ["int", "long"]}
    got = found(r.inclusions(frames(spark, tables, kinds)))
    tables["child"] = (tables["child"][0][:3], [x[:3] for x in tables["child"][1]])
    assert got == plain(tables)
    assert ("child", "parent_id", "parent", "id") in found(r.fk_candidates(frames(spark, tables, kinds)))


def test_many_columns_take_no_more_jobs(spark):
    def tables(n):
        wide = spark.range(40).selectExpr(*[f"id % {i + 1} AS c{i}" for i in range(n)])
        return {"wide": wide, "key": spark.range(30).selectExpr("id"), "none": spark.range(3).selectExpr("id * 0.5 AS x")}

    def jobs(n):
        spark.sparkContext.setJobGroup(f"inclusions {n}", "")
        got = found(r.fk_candidates(tables(n)))
        spark.sparkContext.setJobGroup("", "")
        return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"inclusions {n}"))

    (few, a), (many, b) = jobs(3), jobs(140)
    assert few == {("wide", f"c{i}", "key", "id") for i in range(3)} and many == {("wide", f"c{i}", "key", "id") for i in range(30)} | {("key", "id", "wide", f"c{i}") for i in range(39, 140)}
    assert b <= a
    assert found(r.inclusions({"none": tables(1)["none"]})) == set()
