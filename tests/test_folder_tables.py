"""Tables that are folders of files, where a glob names the folder."""

import duckdb
import pytest

from corpusloom.plans import catalog  # noqa: F401  (it registers all queries)
from corpusloom.plans.registry import ORACLES, QUERIES
from corpusloom.sources import io

_ROWS = [(1, "a", "some text", 0.5), (2, "b", None, None), (3, "c", "", 0.9), (4, "d", "more text\n", None)]
_COLUMNS = "doc_id long, id string, text string, fasttext_en double"


@pytest.mark.parametrize("name", ["io1_read_documents", "io9_scan"])
@pytest.mark.parametrize("files", [0, 3])
def test_a_table_of_one_file_or_many(spark, tmp_path, name, files):
    df = spark.createDataFrame(_ROWS, _COLUMNS)
    folder, out = tmp_path / "data", tmp_path / "data" / "documents.parquet"
    if files:
        df.repartition(files).write.parquet(str(out))
    else:
        folder.mkdir()
        df.toPandas().to_parquet(out)
    spark.createDataFrame([(7, "other")], "doc_id long, text string").write.parquet(str(folder / "raw_corpus.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{out}{'/*.parquet' if files else ''}'")
    rel = con.execute(ORACLES[name])
    names, want = [x[0] for x in rel.description], sorted(rel.fetchall(), key=str)
    assert sorted((tuple(r) for r in QUERIES[name](spark, str(folder)).select(*names).collect()), key=str) == want


def test_files_and_folders_that_fit_count_once(spark, tmp_path):
    one = lambda i, path: spark.createDataFrame([(i,)], "id int").coalesce(1).write.parquet(f"{tmp_path}/top.parquet/{path}")  # noqa: E731  (what lies above the folder isn't asked)
    for i, path in enumerate(["docs.parquet", "docs.parquet/docs.parquet", "x[1]/docs.parquet", "others", "docs.parquet.old"]):
        one(i, path)
    ids = lambda glob: sorted(r.id for r in io.read_files(spark, f"{tmp_path}/top.parquet", glob).collect())
    assert ids("docs.parquet") == [0, 1, 2]
    assert ids("{docs,o}*.parquet") == [0, 1, 2]
    assert ids("*.parquet") == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="(?i)infer schema"):
        ids("none.parquet")
