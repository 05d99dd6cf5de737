"""Nulls, empty tables, odd texts, repeated rows, and extra columns of clashing names, for every operator and stage."""

import gc
import hashlib
import sys
from itertools import product

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, kneser_ney, langid, linedup, mixing, quality, queries, rules, sharding, simhash, vecdup

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
N = 13


def test_langid(odd, none):
    model = langid.learn(odd, F.lit(True))
    got = langid.predict(odd, model).collect()
    assert len(got) == N and {r["lang_pred"] for r in got} == {"und"} and {r["score"] for r in got} == {0.0}
    assert langid.predict(none, model).count() == 0
    one = langid.learn(odd.withColumn("lang", F.lit("en")), F.lit(True))
    found = {r["doc_id"]: r["lang_pred"] for r in langid.predict(odd, one).collect()}
    assert found[10] == "en" and found[1] == found[2] == found[3] == found[5] == "und" and found[8] == "en"


def test_simhash(odd, none):
    got = simhash.near_duplicates(odd).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == N and by[1]["fp"] == by[2]["fp"] == by[3]["fp"] == 0 and by[3]["component_id"] == 1
    assert by[9]["component_id"] == 4 and by[11]["component_id"] == 10 and by[None]["component_id"] is None
    assert simhash.near_duplicates(none).count() == 0


def test_quality(spark, odd, none):
    labels = spark.createDataFrame([(10, 1), (11, 1), (5, 0), (6, 0), (6, 1), (None, 1), (2, None), (99, 1)], "doc_id bigint, quality int")
    for learned in (F.lit(True), F.lit(False)):
        model = quality.learn(odd, labels, learned)
        got = quality.scored(odd, model).collect()
        assert len(got) == N and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
        assert quality.scored(none, model).count() == 0
    assert quality.learn(none, labels.where("false"), F.lit(True)).good == b""


def test_rules(spark, odd, none):
    trusted = spark.createDataFrame([(10,), (None,)], "doc_id bigint")
    got = {r["doc_id"]: r for r in rules.rules(odd, trusted).collect()}
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"] and got[1]["llr"] == 0
    assert got[6]["n_repeat_words"] == 30_000 and got[6]["base_failed"] and got[7]["word_chars"] == 60_000 and got[5]["n_symbols"] == 9
    assert got[10]["n_words"] == 12 and got[10]["kept"] and rules.rules(odd, trusted).count() == N
    assert rules.rules(none, trusted).count() == 0


def test_bpe(odd, none):
    got = {r["doc_id"]: r for r in bpe.digests(odd, PATH, PATTERN).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1]["n_tokens"] == 0 and got[1]["ids_sha256"] == got[2]["decoded_sha256"] == empty
    assert got[7]["decoded_sha256"] == hashlib.sha256(b"x" * 60_000).hexdigest()
    assert bpe.digests(none, PATH, PATTERN).count() == 0
    back = bpe.decoded(bpe.encoded(odd.where("doc_id = 8"), PATH, PATTERN), PATH, PATTERN).first()["bytes"]
    assert bytes(back).decode() == odd.where("doc_id = 8").first()["text"]



def test_bpe_leaves_little_in_a_worker(docs, monkeypatch):
    """After a task over a great many different words, what the worker remembers is bounded; it waits beside the workers of later stages."""
    rows, run = docs((1, "a", "en", "s")), []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, function, schema: run.append(function))
    bpe.encoded_rows(rows.select("doc_id", "text"), PATH, PATTERN)
    text = " ".join(map("".join, product("qzxjkvwbyfghmpd", repeat=5)))[: 6 * 300_000 - 1]
    bpe._coders.clear()

    def remembered():
        seen, waiting, total = set(), [bpe._coders], 0
        while waiting:
            x = waiting.pop()
            if id(x) not in seen and not isinstance(x, type):
                seen.add(id(x))
                total += sys.getsizeof(x)
                waiting += [*gc.get_referents(x), *(x if isinstance(x, dict) else ())]
        return total

    def task(t):
        (out,) = run[0](iter([pa.RecordBatch.from_arrays([pa.array([t.encode()]), pa.array([1])], ["_text", "doc_id"])]))
        return out.to_pylist()[0]

    assert task("a")["round_trip"]
    before = remembered()
    got = task(text)
    assert got["round_trip"] and got["n_tokens"] > 300_000
    assert remembered() - before < 30 << 20
    assert task(text) == got  # what is forgotten is found again


def test_language_model(odd, none):
    model = kneser_ney.train(odd, F.lit(True))
    got = kneser_ney.scored(odd, model).collect()
    assert len(got) == N and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1} and all(r["score"] <= 0 and r["base_score"] <= 0 for r in got)
    nothing = kneser_ney.train(none, F.lit(True))
    assert nothing.tokens == 0 and {r["score"] for r in kneser_ney.scored(odd, nothing).collect()} == {0.0}
    assert kneser_ney.scored(none, model).count() == 0


def test_sharding(odd, none):
    got = sharding.interleaved(odd, 8).collect()
    sizes = [sum(r["shard"] == s for r in got) for s in range(8)]
    assert len(got) == N and max(sizes) - min(sizes) <= 1 and all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in enumerate(sizes))
    assert sharding.interleaved(none, 8).count() == 0


def test_mixing(odd, none):
    got = mixing.mixed(odd, queries.levels(), {}, 0.5, 2).collect()
    assert len(got) == N and all(0 <= r["copies"] <= 2 for r in got)
    assert mixing.mixed(none, queries.levels(), {}, 0.5).count() == 0


def test_line_dedup(odd, none):
    got = {r["doc_id"]: r["text"] for r in linedup.deduplicated(odd).collect()}
    assert got[1] is None and got[3] == " \n\t\n " and got[4] == "a" and got[9] == "" and got[11] == "" and got[None] == "a b c d e f"
    assert linedup.deduplicated(odd).count() == N and linedup.deduplicated(none).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [2.0, 0.1], 0), (4, [1.0, 0.0], 1), (5, None, 0), (6, [], 0), (7, [0.0, 0.0], 0), (8, [nan, 1.0], 0), (9, [inf, 1.0], 0), (10, [None, 1.0], 0), (11, [1.0, 0.0], None), (12, [1.0, 0.0, 0.0], 0), (13, [-1.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, n string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vecdup.near_vectors(df, 0.93).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), **{k: (0, k, True) for k in range(4, 14)}}
    assert vecdup.near_vectors(df.where("vec_id < 0"), 0.93).count() == 0


@pytest.mark.parametrize("which", ["odd", "none"])
def test_stages(spark, request, which, tmp_path):
    rows = request.getfixturevalue(which)
    spark.createDataFrame([(10, 1, 0), (5, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == rows.columns
        out.write.parquet(str(tmp_path / str(k)))
        rows = spark.read.parquet(str(tmp_path / str(k)))
    assert rows.where("not round_trip").count() == 0


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory, odd_texts):
    """The tables of the ten queries: with odd rows, numbers that are null or repeat, and clashing names; and without rows."""
    top = tmp_path_factory.mktemp("odd")
    more = [(12, "½ ²", "en", "s"), (13, "Ⅷ ①", None, "s"), (14, "same line here\nother line there\nsame line here", "en", "s"), (14, "same line here\n\n", "en", "s"), (14, "a third text of this number", "de", None), (None, "same line here\nnew words in this line", "en", "s"), (15, "line " * 5 + "\n" + "x" * 70_000, "fr", "t")]
    rows = [(i, t, "en" if k % 3 else None, f"src{k % 4}") for k, (i, t) in enumerate(odd_texts)] + more
    docs = spark.createDataFrame([(*r, 0, *"abcdefgh") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, _doc string, _kept string, _taken string, _text string, fp string, score string, rank string, _row string")
    tables = {
        "documents": docs,
        "labels": spark.createDataFrame([(10, 1, 0), (11, 1, 0), (5, 0, 0), (6, 0, 1), (6, 1, 0), (14, 1, 0), (None, 1, 0), (4, None, None)], "doc_id bigint, quality int, toxic int"),
        "embeddings": spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.1], 0), (None, [1.0, 0.0], 0), (2, None, 0), (3, [0.0, 0.0], None)], "vec_id bigint, embedding array<float>, label int"),
    }
    for kind, keep in (("odd", "true"), ("none", "false")):
        for name, df in tables.items():
            df.where(keep).coalesce(2).write.parquet(f"{top}/{kind}/{name}.parquet")
    return top


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries(spark, folders, name):
    """A row for each row, with flags that are never null, and no number below zero but scores."""
    source = "embeddings" if name.startswith("op2") else "documents"
    got = queries.queries()[name](spark, f"{folders}/odd").collect()
    rows = spark.read.parquet(f"{folders}/odd/{source}.parquet").collect()
    key = "vec_id" if source == "embeddings" else "doc_id"
    assert sorted(str(r[key]) for r in got) == sorted(str(r[key]) for r in rows)
    for r in got:
        found = r.asDict()
        assert all(found[c] in (True, False) for c in ("held_out", "kept", "base_failed", "ambiguous") if c in found)
        assert all(found[c] >= 0 for c in found if c.startswith("n_") and found[c] is not None)
    assert queries.queries()[name](spark, f"{folders}/none").count() == 0


def test_language_of_texts_without_letters(spark, folders):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op1_language_id(spark, f"{folders}/odd").collect()}
    assert got[12] == got[13] == got[5] == ("und", 0.0) and got[10][0] == "en"


def test_lines_of_repeated_and_null_numbers_are_those_of_the_sql(spark, folders):
    got = sorted(map(str, (tuple(r) for r in queries.op10_line_dedup(spark, f"{folders}/odd").collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folders}/odd/documents.parquet/*.parquet'")
    assert got == sorted(map(str, con.execute(queries.oracle_sql()["op10_line_dedup"]).fetchall()))


def test_mixing_gives_nothing_to_weight_0_and_loses_no_budget(docs):
    rows = [(k, "w " * 10, "en" if k % 2 else "de", "a" if k < 10 else "b") for k in range(20)]
    levels = {"source": F.col("source"), "lang": F.col("lang")}
    got = mixing.mixed(docs(*rows), levels, {"source": {"a": 0.8, "b": 0.2}, "lang": {"en": 1.0, "de": 0.0}}, 0.5).collect()
    taken = {r["doc_id"] for r in got if r["copies"]}
    assert all(r["lang"] == "en" for r in got if r["copies"]) and len(taken) == 10  # source a has 50 tokens of the 80 wanted; b makes up for it


def test_mixing_takes_rows_without_number_one_by_one(spark, docs):
    rows = docs(*[(None, f"word {'more ' * 8}n{k}", "en", "src0") for k in range(20)], *[(7, "the same text ten times here in all of it", "en", "src0")] * 20)
    after = corpus_pipeline.mix_sources(spark, rows, "")
    assert 36 <= after.count() < 40 and after.columns == rows.columns


def test_stages_keep_columns_of_any_name(spark, folders, tmp_path):
    docs = spark.read.parquet(f"{folders}/odd/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, f"{folders}/odd")
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() > 0


@pytest.mark.parametrize("sent", [rules.SENT, 0])
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_rules_take_exactly_the_trusted_rows(spark, monkeypatch, sent, kind):
    monkeypatch.setattr(rules, "SENT", sent)
    docs = spark.range(-300, 300).select(F.col("id").cast(kind).alias("doc_id"), F.lit("a").alias("text"), (F.col("id") % 7 == 0).alias("wanted"))
    trusted = docs.where("wanted").select("doc_id").union(spark.createDataFrame([(None,), (None,)], f"doc_id {kind}"))
    found = rules._marked(docs.union(docs.limit(1).withColumn("doc_id", F.lit(None).cast(kind))), trusted, "doc_id", "text")
    assert [found.count(), found.where("_target = 1").count()] == [601, docs.where("wanted").count()]


@pytest.mark.parametrize("size", ["10MB", "-1"])
def test_rules_count_every_trusted_row(spark, size):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), F.col("id").cast("string")).alias("text"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)  # with the identifiers broadcast, and joined by a shuffle
    try:
        same = rules.ratios(docs, docs.select("doc_id"))
        assert same.where("ratio <> 0").count() == 0 and same.count() == 1 << rules.BITS  # target and corpus are the same rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
