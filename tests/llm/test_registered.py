import __spark_entry__
import corpus_pipeline
import pytest
from compare import connect, differences
from fleetwright.llm import language_id
from fleetwright.llm.queries import QUERIES
from fleetwright.llm.sql import SQL
from llm.helpers import awkward_rows, docs_of, plain_components, plain_hits, plain_normal, plain_words
from llm.test_tokens import check_pieces
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name]) == []


def test_all_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()


def test_near_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = plain_components([(r["doc_id"], r["text"]) for r in docs], 3, 90)
    got = QUERIES["op6_jaccard_join"](spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(want)


def test_stages_take_awkward_rows(spark, tmp_path):
    """Nulls, repeats and clashing names in every stage; without any language all rows pass the first."""
    names = ["kept_0", "kept_1", "kept_sha256_of_row", "kept_row_key", "row_key", "said", "id_that_stays"]
    docs = docs_of(spark, awkward_rows()).select("doc_id", "text", "lang", "source", "n_chars")
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(str(i)))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("i", "und3 word4")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    silent = docs.withColumn("lang", F.lit(None).cast("string"))
    assert stages["1 language"](spark, silent, str(tmp_path)).count() == docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names], name
        assert 0 < docs.count() <= before and docs.filter("kept_row_key = '3' AND row_key = '4'").count() == docs.count()
        docs.write.parquet(str(tmp_path / name.split()[0]))
        docs = spark.read.parquet(str(tmp_path / name.split()[0]))
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.columns == docs.columns and empty.isEmpty()
    assert stages["8 packing"](spark, docs, str(tmp_path)).select("doc_id").distinct().count() > 3


def test_pipeline(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in frame.collect()}
    profiles = language_id.Profiles(language_id.learn(frame.filter(
        ~language_id.held_out(frame["doc_id"])).select("lang", "text")))
    kept = [i for i in sorted(rows) if profiles.nearest(rows[i])[0] != "und"]
    seen, first = set(), []
    for i in kept:
        if plain_normal(rows[i]) not in seen:
            first.append(i)
        seen.add(plain_normal(rows[i]))
    near = [i for i, _, c in plain_components([(i, rows[i]) for i in first], 5, 80) if i == c]
    items = [(str(r["item_id"]), plain_words(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = [i for i in near if not plain_hits(plain_words(rows[i]), items)[0]]
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted({p["doc_id"] for p in pieces}) == clean and len(clean) < len(near) < len(first) < len(kept) <= len(rows)
    check_pieces(pieces, [(i, rows[i], None, None) for i in clean])
    assert [name.split()[0] for name, _ in corpus_pipeline.STAGES] == ["1", "3", "6", "10", "8"]
