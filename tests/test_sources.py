import pytest

from sourcelens.sources import audits, names, tabular


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return path


def test_strict_reader(spark, tmp_path):
    df, info = tabular.read_metadata_with_fingerprint(spark, write(tmp_path / "m.csv", '﻿a,b\r\n001,"x, ""y""\nz"\n2,\n'))
    rows = df.orderBy("row_position").collect()
    assert [tuple(r)[:2] for r in rows] == [("001", 'x, "y"\nz'), ("2", "")] and info["format"] == "csv" and info["size_bytes"] > 0
    assert tabular.read_metadata(spark, write(tmp_path / "m.tsv", "a\tb\n1\t2\n")).first().b == "2"
    for text in ("", "a,b\n", "a,a\n1,2\n", "a, \n1,2\n", "a,b\n1\n", "a,b\n1,2,3\n", "a,b\n\n1,2\n", "a,b\n1,\x00\n", 'a,b\n"1,2\n'):
        with pytest.raises(tabular.MetadataReadError):
            tabular.read_metadata(spark, write(tmp_path / "bad.csv", text))
    with pytest.raises(tabular.MetadataReadError):
        tabular.read_metadata(spark, write(tmp_path / "l.csv", "a,b\né,2\n", "latin-1"))
    with pytest.raises(tabular.MetadataReadError):
        tabular.read_metadata(spark, write(tmp_path / "m.txt", "a,b\n1,2\n"))


def test_tolerant_reader(spark, tmp_path):
    for d in "\t,;|":
        p = write(tmp_path / "t.txt", f"﻿a {d} b\n1{d}2\n3{d}4\n")
        assert tabular.sniff_separator(p) == d
        assert tabular.read_table(spark, p).columns == ["a", "b"]
    with pytest.raises(ValueError):
        tabular.read_table(spark, write(tmp_path / "one.txt", "a\n1\n"))
    with pytest.raises(FileNotFoundError):
        tabular.read_table(spark, tmp_path / "none")
    p = write(tmp_path / "c.csv", "s,u,g,w\nx,1,A,2\ny,2,B,3\n")
    c = tabular.from_csv(spark, p, source="s", unit="u", group="g", weight="w")
    assert c.name == "c" and c.counts()["total_weight"] == 5


def test_excel_needs_an_engine(spark, tmp_path):
    with pytest.raises((ImportError, FileNotFoundError)):
        tabular.from_excel(spark, tmp_path / "x.xlsx", source="a", unit="b", group="c")


def test_names(spark):
    files = ["d/PXD001_D01_case.raw", "PXD001_D02_ctrl.raw", "d\\PXD002_D03_case.mzML"]
    c = names.from_filenames(files, {"source": 0, "unit": 1, "group": -1}, source_field="source", unit_field="unit", group_field="group", spark=spark)
    assert c.counts()["n_sources"] == 2 and c.counts()["n_groups"] == 2
    df = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    with pytest.raises(ValueError, match="tokens"):
        names.parse_run_names(df("a_b", "c_d", "e"), {"x": 0})
    with pytest.raises(ValueError, match="empty"):
        names.parse_run_names(df("a__b"), {"x": 1})
    with pytest.raises(ValueError, match="repeat"):
        names.parse_run_names(df("a_b", "a_b"), {"x": 1})
    with pytest.raises(ValueError):
        names.parse_run_names(df("a_b"), {"x": 2})
    with pytest.raises(ValueError):
        names.parse_run_names(df("a_b"), {"run": 0})
    with pytest.raises(TypeError):
        names.parse_run_names(df("a_b"), {"x": True})
    with pytest.raises(KeyError):
        names.from_filenames(files, {"source": 0}, source_field="source", unit_field="unit", group_field="g", spark=spark)


def test_sdrf(spark):
    df = spark.createDataFrame([("r1", "d1", "A"), ("r2", "d2", "B")], "`comment[data file]` string, `source  name` string, `characteristics[group]` string")
    c = names.from_sdrf(df, source_col="Comment[Data File]", unit_col="source name", group_col="characteristics[group]")
    assert c.counts()["n_units"] == 2
    with pytest.raises(KeyError):
        names.from_sdrf(df, source_col="nothing", unit_col="source name", group_col="characteristics[group]")


PROSE = ["identified 1,200 peptides in 300 runs", "450 proteins from 12 samples", "none"]


def test_audits(spark):
    df = spark.createDataFrame([("PXD001234", p, str(i), "A" if i else "B") for i, p in enumerate(PROSE)], "accession string, note string, n string, condition string")
    a = {r.column: r for r in audits.with_prose(audits.numeric_audit(df)).collect()}
    assert a["note"].n_direct_numeric == 0 and a["note"].n_multi_number == 2 and a["note"].looks_like_prose and a["note"].extracted_max == 1200
    assert a["n"].frac_direct_numeric == 1 and not a["n"].looks_like_prose
    p = {r.column: r for r in audits.column_profile(df).collect()}
    assert p["accession"].frac_accession_like == 1 and p["condition"].n_unique == 2
    with pytest.raises(ValueError):
        names.from_incidence_table(df, source="accession", unit="n", group="condition", weight="note")
    with pytest.raises(ValueError):
        audits.numeric_audit(df, min_digits=0)
    assert audits.unsafe_weight_name("total_count") and audits.unsafe_weight_name("Dataset runs") and not audits.unsafe_weight_name("intensity")
    with pytest.raises(KeyError):
        audits.infer_columns(df, {"nobody": ["x"]})


def test_recoverability(spark):
    df = spark.createDataFrame([("s1", "u1", "A", "1"), ("s1", "u2", "B", "2"), ("s2", "u3", "A", "x")], "source string, unit string, `group` string, w string")
    got = {r.check: r for r in audits.check_recoverability(df, source="source", unit="unit", group="group", weight="w").collect()}
    assert got["corpus_constructible"].status == "blocked" and got["weight_column_usable"].value == 1 and got["sources_spanning_groups"].value == 1
    missing = {r.check: r.status for r in audits.check_recoverability(df, source="nope", unit="unit", group="group").collect()}
    assert missing["required_columns_present"] == "blocked" and missing["weight_column_usable"] == "unknown"
