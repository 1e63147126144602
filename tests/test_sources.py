import bz2
import gzip
import lzma

from pyspark.sql import functions as F

from sweepframe.sources import readers as R


def test_headers_and_tables(spark, tmp_path):
    d = tmp_path / "t"
    d.mkdir()
    (d / "a.tsv").write_text("#{N: 500, alpha: 0.5, name: 'it''s'}\nx\ty\n1\t2.5\nNA\t3\n")
    with bz2.open(d / "b.tsv.bz2", "wt") as f:
        f.write("# {N: 7, extra: yes}\nx\ty\n5\t6\nEOF\n")
    with gzip.open(d / "c.nwk.gz", "wt") as f:
        f.write("#{m: 2}\n((a:1,b:2):1,c:3);\n")
    (d / "m.mtx").write_text("%%MatrixMarket matrix array real symmetric\n%{kind: kernel}\n2 2\n1\n0.5\n1\n")
    (d / "g.gml").write_text('graph [\n  comment "{N: 3, power: 1.0}"\n  node [\n id 1\n remove 0.5\n ]\n node [ id 2 ]\n edge [ source 1 target 2 transmit 1.5 ]\n]\n')
    meta = {r.path.rsplit("/", 1)[1]: r.metadata for r in R.collect_metadata(spark, str(d / "*")).collect()}
    assert meta["a.tsv"] == {"N": "500", "alpha": "0.5", "name": "it's"} and meta["b.tsv.bz2"] == {"N": "7", "extra": "yes"}
    assert meta["m.mtx"] == {"kind": "kernel"} and meta["g.gml"] == {"N": "3", "power": "1.0"} and meta["c.nwk.gz"] == {"m": "2"}
    t = R.read_table(spark, str(d / "*.tsv*"), "x int, y double")
    both = R.with_metadata(t, R.collect_metadata(spark, str(d / "*.tsv*")), ["N", "x"])
    assert sorted((r.x, r.y, r.N) for r in both.collect() if r.x) == [(1, 2.5, "500"), (5, 6.0, "7")]
    assert both.count() == 3 and "x_meta" in both.columns
    v, e = R.read_gml(spark, str(d / "*.gml"))
    assert sorted((r.id, r.remove) for r in v.collect()) == [(1, 0.5), (2, None)]
    assert [(r.src, r.dst, r.transmit) for r in e.collect()] == [(1, 2, 1.5)]


def test_xz(spark, tmp_path):
    (tmp_path / "a.tsv.xz").write_bytes(lzma.compress(b"one\ntwo\n"))
    assert [r.line for r in R.xz_lines(spark, str(tmp_path / "*.xz")).orderBy("line_no").collect()] == ["one", "two"]


def test_matrix_round_trip(spark, tmp_path):
    n = 7
    full = [(i, j, float(min(i, j) * 10 + max(i, j))) for i in range(1, n + 1) for j in range(1, n + 1)]
    R.write_matrix(spark.createDataFrame(full, "i long, j long, v double"), str(tmp_path / "w"))
    parts = sorted((tmp_path / "w").glob("part-*"))
    (tmp_path / "whole.mtx").write_text("".join(p.read_text() for p in parts))
    got = sorted((r.i, r.j, r.v) for r in R.read_matrix(spark, str(tmp_path / "whole.mtx")).collect())
    assert got == sorted(full)
    (tmp_path / "g.mtx").write_text("%%MatrixMarket matrix array real general\n2 2\n1\n2\n3\n4\n")
    assert sorted((r.i, r.j, r.v) for r in R.read_matrix(spark, str(tmp_path / "g.mtx")).collect()) == [(1, 1, 1.0), (1, 2, 3.0), (2, 1, 2.0), (2, 2, 4.0)]
    (tmp_path / "c.mtx").write_text("%%MatrixMarket matrix coordinate real general\n3 3 2\n1 3 0.5\n2 2 1.5\n")
    assert sorted((r.i, r.j, r.v) for r in R.read_matrix(spark, str(tmp_path / "c.mtx")).collect()) == [(1, 3, 0.5), (2, 2, 1.5)]


def test_newick(spark):
    df = spark.createDataFrame([("t", "#{N: 1}\n((a:1,'b c':2)x:1,c:3,,d)r;"), ("bad", "((a"), ("none", None), ("empty", "")], "k string, nwk string")
    rows = {r.label or r.node: r for r in R.parse_newick(df, "k", "nwk").where("tree = 't'").collect()}
    assert rows["r"].parent is None and rows["x"].parent == rows["r"].node and rows["a"].parent == rows["x"].node
    assert (rows["b c"].length, rows["b c"].is_tip, rows["b c"].child_pos, rows["x"].is_tip) == (2.0, True, 2, False)
    assert len(rows) == 7


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">p1_12000\nACG\nT-A\n>p2\nGG\n")
    assert sorted((r.id, r.t, r.seq) for r in R.read_fasta(spark, str(tmp_path / "*.fasta")).collect()) == [("p1", 12000, "ACGT-A"), ("p2", None, "GG")]


def test_tsv_writer(spark, tmp_path):
    R.write_table(spark.createDataFrame([(1, "a b")], "x int, y string"), str(tmp_path / "o"), "bzip2")
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "o")).collect()[0].y == "a b"
    assert R.files(spark, str(tmp_path / "o/*.bz2")).where(F.col("length") > 0).count() >= 1
