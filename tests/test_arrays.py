"""Array files, bucketed tables and the variational fold."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.jobs import infer
from tidewell.operators import series, variational
from tidewell.sources import netcdf, reports, sinks

KINDS = {"S": (2, "S1"), "h": (3, ">i2"), "i": (4, ">i4"), "f": (5, ">f4"), "d": (6, ">f8")}


def classic(version, dims, variables, records=0):
    """A file by the published grammar. dims: name -> size, 0 for the record dimension; variables: name -> (dims, kind, array, attributes)."""
    count = lambda n: struct.pack(">q" if version == 5 else ">i", n)
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: count(len(s)) + pad(s.encode())
    many = lambda tag, items: struct.pack(">i", tag if items else 0) + count(len(items)) + b"".join(items)
    offset = lambda n: struct.pack(">i" if version == 1 else ">q", n)
    order = list(dims)
    raw = {n: np.asarray(a).astype(KINDS[k][1]) for n, (_, k, a, _) in variables.items()}
    is_record = {n: bool(d) and dims[d[0]] == 0 for n, (d, *_) in variables.items()}
    width = {n: raw[n][0].nbytes if is_record[n] else raw[n].nbytes for n in variables}
    alone = sum(is_record.values()) == 1

    def header(begins):
        out = b"CDF" + bytes([version]) + count(records) + many(10, [name(d) + count(n) for d, n in dims.items()]) + many(12, [name("title") + struct.pack(">i", 2) + count(5) + pad(b"arbit")])
        items = []
        for n, (d, k, _, attributes) in variables.items():
            given = [name(a) + struct.pack(">i", 6) + count(1) + struct.pack(">d", x) for a, x in attributes.items()]
            items.append(name(n) + count(len(d)) + b"".join(count(order.index(x)) for x in d) + many(12, given) + struct.pack(">i", KINDS[k][0]) + count(-(-width[n] // 4) * 4) + offset(begins[n]))
        return out + many(11, items)

    at, begins = len(header(dict.fromkeys(variables, 0))), {}
    for n in sorted(variables, key=lambda n: is_record[n]):
        begins[n] = at
        at += width[n] if is_record[n] and alone else -(-width[n] // 4) * 4
    body = b"".join(pad(raw[n].tobytes()) for n in variables if not is_record[n])
    for i in range(records):
        for n in variables:
            if is_record[n]:
                body += raw[n][i].tobytes() if alone else pad(raw[n][i].tobytes())
    return header(begins) + body


@pytest.mark.parametrize("version", [1, 2, 5])
def test_draws_of_many_files(spark, tmp_path, version):
    """y[chain, draw, time] of one file a series, by coordinates, in slabs."""
    rng = np.random.default_rng(version)
    want = {}
    for gene in ("ENSDARG01", "ENSDARG02"):
        y = rng.normal(size=(2, 3, 4))
        y[0, 1, 2], y[1, 0, 0] = -999.0, np.nan
        (tmp_path / gene).mkdir()
        times = [0.5, 1.0, 2.0, 4.0]
        content = classic(version, {"chain": 2, "draw": 3, "time": 4}, {"time": (["time"], "d", times, {}), "chain": (["chain"], "i", [0, 1], {}), "y": (["chain", "draw", "time"], "d", y, {"_FillValue": -999.0})})
        (tmp_path / gene / "posterior.nc").write_bytes(content)
        want |= {(gene, c, d, times[t]): None if np.isnan(y[c, d, t]) or y[c, d, t] == -999 else y[c, d, t] for c in range(2) for d in range(3) for t in range(4)}
    for slab in (1, 5, 200_000):
        rows = netcdf.netcdf(spark, str(tmp_path), "y", {"chain": "long", "draw": "long", "time": "double"}, slab_rows=slab)
        got = {(r.gene, r.chain, r.draw, r.time): r.y for r in rows.withColumn("gene", F.regexp_extract("path", "ENSDARG[0-9]+", 0)).collect()}
        assert got == want


def test_records_text_and_other_types(spark, tmp_path):
    genes = np.array([list("g1\0"), list("g22")], dtype="S1")
    two = {"gene": (["gene", "letters"], "S", genes, {}), "y": (["time", "gene"], "f", [[1.5, 2.5], [3.5, 4.5], [5.5, 6.5]], {}), "odd": (["time", "three"], "h", [[1, 2, 3]] * 3, {})}
    (tmp_path / "a.nc").write_bytes(classic(1, {"time": 0, "gene": 2, "letters": 3, "three": 3}, two, records=3))
    rows = netcdf.netcdf(spark, str(tmp_path), "y", {"time": "long", "gene": "string"}, slab_rows=2)
    assert sorted((r.time, r.gene, r.y) for r in rows.collect()) == [(0, "g1", 1.5), (0, "g22", 2.5), (1, "g1", 3.5), (1, "g22", 4.5), (2, "g1", 5.5), (2, "g22", 6.5)]
    assert netcdf.netcdf(spark, str(tmp_path), "odd", {"time": "long", "three": "long"}).agg(F.sum("y")).first()[0] == 18.0
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.nc").write_bytes(classic(2, {"time": 0, "three": 3}, {"odd": (["time", "three"], "h", [[1, 2, 3], [4, 5, 6]], {})}, records=2))
    assert sorted(r.y for r in netcdf.netcdf(spark, str(tmp_path / "b"), "odd", {"time": "long", "three": "long"}).collect()) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(Exception, match="b.nc: .*dimensions time, three"):
        netcdf.netcdf(spark, str(tmp_path / "b"), "odd", {"time": "long"}).collect()
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "c.nc").write_bytes(b"\x89HDF and more")
    with pytest.raises(Exception, match="c.nc: no classic NetCDF"):
        netcdf.netcdf(spark, str(tmp_path / "c"), "y", {"time": "long"}).collect()


def test_dataset_from_arrays(spark, tmp_path):
    """A dataset y[time, gene] to parquet and through the reader of datasets."""
    content = classic(1, {"time": 2, "gene": 2, "letters": 2}, {"time": (["time"], "d", [0.0, 3.5], {}), "gene": (["gene", "letters"], "S", np.array([list("ga"), list("gb")], dtype="S1"), {}), "y": (["time", "gene"], "d", [[1.0, 2.0], [3.0, 4.0]], {})})
    (tmp_path / "mean.nc").write_bytes(content)
    rows = netcdf.netcdf(spark, str(tmp_path), "y", {"time": "double", "gene": "string"}).drop("path")
    rows.union(rows.withColumn("y", F.col("y") + 1)).write.parquet(str(tmp_path / "set"))
    assert sorted((r.gene, r.time, r.y) for r in reports.series_dataset(spark, str(tmp_path / "set")).collect()) == [("ga", 0.0, 1.5), ("ga", 3.5, 3.5), ("gb", 0.0, 2.5), ("gb", 3.5, 4.5)]
    assert reports.series_dataset(spark, str(tmp_path / "set"), "full").count() == 8


def test_bucketed_tables_meet_without_a_shuffle(spark):
    rows = spark.range(200).select((F.col("id") % 3).alias("model"), F.col("id").alias("gene"), F.rand(1).alias("nrmse"))
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = sinks.write_bucketed(rows, "merged_one", ["model", "gene"], 4)
        two = sinks.write_bucketed(rows.withColumnRenamed("nrmse", "other"), "merged_two", ["model", "gene"], 4)
        for query, n in ((one.join(two, ["model", "gene"]), 200), (one.groupBy("model", "gene").agg(F.max("nrmse").alias("m")), 200)):
            plan = query._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and query.count() == n
        assert sinks.write_bucketed(rows.limit(5), "merged_one", ["model", "gene"], 4).count() == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)
        for name in ("merged_one", "merged_two"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_variational_means_are_those_of_chains(spark):
    t = np.linspace(0, 30, 18)
    rng = np.random.default_rng(3)
    curves = {g: np.expm1(np.log1p(infer.predict("basic", p, 20.0, t)) + 0.05 * rng.normal(size=len(t))) for g, p in (("a", {"beta": 1.0, "delta": 0.2}), ("b", {"beta": 3.0, "delta": 0.3}))}
    rows = [(g, float(a), float(b)) for g, y in curves.items() for a, b in zip(t, y)] + [("a", 31.0, float("nan")), ("low", 0.0, 1.0), ("low", 1.0, -2.0), ("low", 2.0, 1.0)]
    df = spark.createDataFrame(rows, "gene string, time double, y double")
    got = {r.gene: r for r in variational.fit(df, series.initial_values(df.where("NOT isnan(y)")), 3000, 0.01).collect()}
    assert got["low"].beta_mean is None
    for g, y in curves.items():
        chains = [infer.sample("basic", t, y, seed, 1000, 8000) for seed in (1, 2)]
        for name in variational.NAMES:
            logs = np.log(np.concatenate([c[name] for c in chains]))
            assert abs(got[g][f"{name}_mean"] - logs.mean()) < 0.05 * max(1.0, abs(logs.mean())), (g, name)
