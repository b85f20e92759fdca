"""Files: delimiters, encodings, newest file, replaced tables, results."""

import hashlib
import os
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)

from assaylane.operators.columns import col
from assaylane.session import scratch_dir
from assaylane.sources import digests, files, versions
from assaylane.sources.rows import with_row_index


def write(path, content):
    path.write_bytes(content)
    return str(path)


def test_newest_file_any_case_not_recursive(spark, tmp_path):
    for age, name in ((30, "old.csv"), (20, "new.CSV"), (10, "other.txt")):
        write(tmp_path / name, b"a\n1\n")
        os.utime(tmp_path / name, (time.time() - age,) * 2)
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub" / "deep.csv", b"a\n1\n")
    assert files.latest_file(spark, str(tmp_path)).endswith("/new.CSV")
    with pytest.raises(FileNotFoundError):
        files.latest_file(spark, str(tmp_path / "gone"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        files.latest_file(spark, str(tmp_path / "empty"))


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, sep):
    text = sep.join(["id", "Molecule ChEMBL ID", "v"]) + "\n" + sep.join(["1", f'"a{sep}""b"""', "NA"]) + "\n"
    df = files.read_delimited(spark, write(tmp_path / "x.csv", text.encode()))
    assert df.columns == ["id", "Molecule ChEMBL ID", "v"]
    assert [tuple(r) for r in df.collect()] == [("1", f'a{sep}"b"', None)]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1252"])
def test_encodings(spark, tmp_path, encoding):
    text = "señal;precio €\nñandú;“5”\n"
    df = files.read_delimited(spark, write(tmp_path / "x.csv", text.encode(encoding)))
    assert df.columns == ["señal", "precio €"]
    assert [tuple(r) for r in df.collect()] == [("ñandú", "“5”")]


def test_inferred_types(spark, tmp_path):
    text = "a,b,c,d,e,f\n1,1.5,True,x,,1\n2,nan,False,1,,1d\n,1e3,,2,,2\n"
    df = files.read_delimited(spark, write(tmp_path / "x.csv", text.encode()), infer=True)
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "string", "string"]
    assert [tuple(r) for r in df.orderBy("a").collect()] == [
        (None, 1000.0, None, "2", None, "2"), (1, 1.5, True, "x", None, "1"), (2, None, False, "1", None, "1d"),
    ]


def test_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path / "x.csv", b'a,b\n"one\ntwo",2\n')
    assert files.read_delimited(spark, path, multi_line=True).first()["a"] == "one\ntwo"


def test_table_is_replaced_by_its_enriched_form(spark, tmp_path):
    path = str(tmp_path / "table")
    for fmt in ("parquet", "csv"):
        files.write_table(spark.range(5).withColumn("t", F.lit("")), path, fmt)
        out = files.enrich_table(spark, path, lambda df: df.withColumn("double", col("id") * 2), fmt)
        assert sorted((r["id"], r["double"], r["t"]) for r in out.collect())[1][:2] == (1, 2)
        assert sorted(p.name for p in tmp_path.iterdir()) == ["table"]


def test_results_file(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", 0.1234567, "x;y"), (1, "a", 1.0, "")], "Rank int, ID string, Prob_activo double, Filtros string")
    path = files.write_results(df, str(tmp_path), "20240102")
    lines = [line for part in sorted(os.listdir(path)) if part.startswith("part-")
             for line in open(os.path.join(path, part), encoding="utf-8").read().splitlines()]
    rows = [line for line in lines if not line.startswith("\ufeffRank")]
    assert len(rows) < len(lines)
    assert files.read_delimited(spark, path).columns == ["Rank", "ID", "Prob_activo", "Filtros"]
    assert path.endswith("resultados_20240102.csv")
    assert rows == ["1;a;1.000000;", '2;b;0.123457;"x;y"']


def test_hashes(spark, tmp_path):
    path = write(tmp_path / "x.bin", b"some bytes")
    assert files.file_sha256(spark, path).first()["sha256"] == hashlib.sha256(b"some bytes").hexdigest()
    df = spark.range(100).withColumn("t", F.when(col("id") % 2 == 0, "x"))
    assert files.table_fingerprint(df).first() == files.table_fingerprint(df.repartition(7)).first()
    assert files.table_fingerprint(df).first() != files.table_fingerprint(df.where("id > 0")).first()


@pytest.mark.parametrize(
    "content",
    [b"a", b"a\n", b"\n\n", b"\xef\xbb\xbfa;b\n1;2\n", b"\xef\xbb\xbfa", b"a\r\nb\r\n", bytes(range(256)) * 5_000, "ñ\n".encode() * 70_000],
)
def test_digest_in_parts(spark, tmp_path, content):
    paths = [write(tmp_path / f"{i}.bin", content + b"x" * i) for i in range(3)]
    got = {os.path.basename(r["path"]): r["sha256"] for r in files.file_sha256(spark, str(tmp_path), whole=0).collect()}
    assert got == {os.path.basename(p): hashlib.sha256(open(p, "rb").read()).hexdigest() for p in paths}


@pytest.mark.parametrize("goes_on", [True, False])
def test_digest_in_rounds(spark, tmp_path, monkeypatch, goes_on):
    lines = b"".join(b"%d,%s\n" % (i, b"x" * (i % 90)) for i in range(3_000))
    contents = [lines + b"end", b"\xef\xbb\xbf" + lines, lines[:70_000], b"y" * 45_000 + b"\n" + lines, b"\n" * 30_000, b"a"]
    for i, content in enumerate(contents):
        write(tmp_path / f"{i}.bin", content)
    real, limit = files._go_on, 20_000 + 10_000 + 45_001 if goes_on else 1 << 30

    def watched(batches):
        def counted():
            read = 0
            for batch in batches:
                read += sum(len(data) for data in batch.column("data").to_pylist())
                if read > limit:
                    raise ValueError(f"a task reads {read} bytes")
                yield batch

        yield from real(counted())

    monkeypatch.setattr(files, "_go_on", watched)
    monkeypatch.setattr(files, "_PIECE", 3_000)
    if not goes_on:
        monkeypatch.setattr(files, "workers_can_go_on", lambda spark: False)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = files.file_sha256(spark, str(tmp_path), whole=0, part=20_000).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {os.path.basename(r["path"]): r["sha256"] for r in rows}
    assert got == {f"{i}.bin": hashlib.sha256(content).hexdigest() for i, content in enumerate(contents)} and len(rows) == len(contents)
    assert not [f for f in os.listdir(scratch_dir(spark)) if f.startswith("pieces-")]


def test_digest_is_taken_up(monkeypatch):
    data = bytes(range(256)) * 20
    want = hashlib.sha256(data).hexdigest()
    assert digests.can_go_on()
    for cut in (0, 1, 55, 56, 63, 64, 65, 128, 5_000, len(data)):
        first = digests.Sha256()
        first.update(data[:cut])
        second = digests.Sha256(first.state())
        second.update(data[cut:])
        assert second.hexdigest() == second.hexdigest() == want and first.hexdigest() == hashlib.sha256(data[:cut]).hexdigest()
    state = first.state()
    monkeypatch.setattr(digests, "_openssl", lambda: None)
    plain = digests.Sha256()
    plain.update(data)
    assert plain.hexdigest() == want and not digests.can_go_on()
    with pytest.raises(RuntimeError):
        digests.Sha256(state)


def test_fingerprint_tells_cells_apart(spark):
    tables = [
        spark.createDataFrame([(a, b)], "a string, b string")
        for a, b in ((None, "x"), ("", "x"), ("\\N", "x"), ("n", "x"), ("x", ""), ("x", None), ("\x1fx", ""), ("1", "x"))
    ]
    tables += [spark.createDataFrame([(1, "x")], "a long, b string"), spark.createDataFrame([(1.0, "x")], "a double, b string")]
    prints = [files.table_fingerprint(t).first()["checksum"] for t in tables]
    assert len(set(prints)) == len(prints)
    assert files.table_fingerprint(tables[0].where("false")).first()["n_rows"] == 0


def test_every_file_has_its_own_dialect(spark, tmp_path):
    write(tmp_path / "a.csv", "id;señal\n1;ñ\n".encode())
    write(tmp_path / "b.csv", "señal,id\n“x”,2\n".encode("cp1252"))
    write(tmp_path / "c.csv", "id;señal\n3;é\n".encode("utf-8-sig"))
    write(tmp_path / "d.csv", "id\textra\n4\tmore\n".encode())
    df = files.read_delimited(spark, str(tmp_path), row_index="row_idx")
    got = {r["id"]: (r["señal"], r["extra"], r["row_idx"]) for r in df.collect()}
    assert got == {"1": ("ñ", None, 0), "2": ("“x”", None, 1), "3": ("é", None, 2), "4": (None, "more", 3)}


def test_row_index_follows_the_files(spark, tmp_path):
    lines = [f"{i},{'x' * (i % 50)}" for i in range(20_000)]
    for part in range(4):
        write(tmp_path / f"{part}.csv", ("id,t\n" + "\n".join(lines[part * 5_000 : (part + 1) * 5_000]) + "\n").encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = spark.read.csv(str(tmp_path), header=True)
        assert raw.rdd.getNumPartitions() > 8
        for df in (raw, raw.where("t IS NOT NULL"), raw.select("id")):
            got = [int(r["id"]) for r in with_row_index(df).orderBy("row_idx").collect()]
            assert got == sorted(got) and len(got) == df.count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    made = with_row_index(spark.range(1000).repartition(7).join(spark.range(500), "id"), start=5)
    assert sorted(r["row_idx"] for r in made.collect()) == list(range(5, 505))
    assert with_row_index(spark.range(0)).count() == 0
    with pytest.raises(ValueError):
        with_row_index(made)


def test_a_swap_cut_short_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    files.write_table(spark.range(5), path)
    real, calls = versions.rename, []

    def stop(*args):
        calls.append(args)
        if len(calls) == 2:
            raise OSError("stopped")
        real(*args)

    with monkeypatch.context() as m:
        m.setattr(versions, "rename", stop)
        with pytest.raises(OSError):
            files.enrich_table(spark, path, lambda df: df.withColumn("x", F.lit(1)))
    assert files.read_table(spark, path).columns == ["id"] and files.read_table(spark, path).count() == 5
    assert files.enrich_table(spark, path, lambda df: df.withColumn("x", F.lit(1))).columns == ["id", "x"]
    root = str(tmp_path / "v")
    for n in (3, 4, 5):
        files.write_version(spark.range(n), root)
    assert files.read_table(spark, root).count() == 5 and len(list((tmp_path / "v" / "_versions").iterdir())) == 2


def test_tabs_at_cell_ends(spark, data, monkeypatch):
    from checks.registry import QUERIES
    from checks.standins import assay

    read, whole = files.read_delimited, []
    monkeypatch.setattr(files, "read_delimited", lambda *a, **k: whole.append(read(*a, **k)) or whole[-1])
    names = ["row_idx", "Standard Relation"]
    QUERIES["delimited_read"](spark, data)
    got = {tuple(r) for r in whole[0].select(*names).collect()}
    assert got == {(str(i), v) for i, v in assay(spark, data).select(*names).collect()}
    assert any((v or "").startswith("\t") for _, v in got)


def test_hashes_of_every_table(spark, data):
    from checks.registry import QUERIES

    want = {}
    for folder, _, names in os.walk(data):
        for name in names:
            with open(os.path.join(folder, name), "rb") as f:
                want[name] = hashlib.sha256(f.read()).hexdigest()
    got = {os.path.basename(r["path"]): r["sha256"] for r in QUERIES["file_hashes"](spark, data).collect()}
    assert "lineitem.parquet" in got and got == {n: want[n] for n in got} and len(got) == len(want)


def test_exports_are_sorted_in_ranges_that_follow_from_the_table(spark, tmp_path, monkeypatch):
    from checks import chain, standins, tables
    from checks.registry import QUERIES

    df = spark.createDataFrame([(i * 7 % 200, "x" * 1_000) for i in range(200)], "id long, `a text` string")
    ranges = standins.in_ranges(df, "id", "a text", range_bytes=10_000)
    assert ranges.rdd.getNumPartitions() == 20 and [r.id for r in ranges.collect()] == list(range(200))
    assert standins.in_ranges(df, "id", "a text").rdd.getNumPartitions() == 3
    docs = spark.createDataFrame([(i * 7 % 100, "a b " * 500, 2_000) for i in range(100)], "doc_id long, text string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for module in (chain, tables):
        monkeypatch.setattr(module, "in_ranges", lambda *a: standins.in_ranges(*a, range_bytes=20_000))
    assert len([f for f in os.listdir(chain.export(spark, str(tmp_path)).removeprefix("file:")) if f.endswith(".csv")]) > 3
    got = [tuple(r) for r in QUERIES["rows_indexed"](spark, str(tmp_path)).orderBy("row_idx").collect()]
    assert got == [(i, str(i)) for i in range(100)]
