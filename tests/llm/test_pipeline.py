"""The pipeline on planted cases, each stage held against what it should keep, and the registered queries against SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from burstlake.llm.shared import words

TABLES = "documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder of tables with toxic documents, groups of copies, benchmark passages, and sources of several sizes."""
    rng = random.Random(5)
    word = lambda: rng.choice("bcdfgklmn") + rng.choice("aeiou") + str(rng.randrange(80))
    text = lambda n: " ".join(word() for _ in range(n))
    bench = [(k, text(40)) for k in range(6)]
    docs, labels = [], []
    for k in range(300):
        t, kind = text(rng.randint(20, 120)), "clean"
        if k % 6 == 0:
            w = t.split()
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "scum"]))
            t, kind = " ".join(w), "toxic"
        elif k % 25 == 1:
            b = bench[k % 6][1].split()
            t, kind = t + " " + " ".join(b[20:] + b[:20]), "leak"
        docs.append((k, t, "en", f"s{k % 4}", len(t), kind))
        labels.append((k, 1, int(kind == "toxic")))
    for k in range(20):
        t = docs[2 + 6 * k][1].split()
        t[len(t) // 2 : len(t) // 2 + (k % 2)] = ["changed"] * (k % 2) if len(t) > 90 else t[len(t) // 2 : len(t) // 2 + (k % 2)]
        docs.append((1000 + k, " ".join(t), "en", "s0", 0, "copy"))
    docs += [(2000, None, None, None, None, "null"), (2001, "", "en", "s1", 0, "empty"), (None, "no id here " + text(30), "en", "s2", 0, "noid")]
    at = tmp_path_factory.mktemp("planted")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, kind string").write.parquet(str(at / "all.parquet"))
    spark.read.parquet(str(at / "all.parquet")).drop("kind").write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at)


def test_stages(spark, planted):
    kind = {r.doc_id: r.kind for r in spark.read.parquet(f"{planted}/all.parquet").collect()}
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, planted)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), after.schema)
        seen.append([r.doc_id for r in docs.collect()])
    toxic, unique, clean, mixed = seen
    lost = [k for k in kind if kind[k] != "toxic" and k not in toxic]
    assert len([k for k in toxic if kind[k] == "toxic"]) <= 3 and len(lost) <= 3
    assert not [k for k in unique if kind[k] == "copy" and k in toxic and (2 + 6 * (k - 1000)) in unique] and set(toxic) - set(unique) <= {k for k in kind if kind[k] == "copy"}
    assert not [k for k in clean if kind[k] == "leak"] and set(unique) - set(clean) <= {k for k in kind if kind[k] == "leak"}
    assert {2000, 2001, None} <= set(clean) and set(mixed) <= set(clean) and len(mixed) > len(set(mixed))


def test_run(spark, planted):
    got = corpus_pipeline.run(spark, planted).toPandas()
    per = got.groupby("shard").slot
    assert per.count().max() - per.count().min() <= 1 and all(sorted(s) == list(range(len(s))) for _, s in per)
    assert {"doc_id", "text", "lang", "source", "n_chars"} <= set(got.columns)


def test_stages_on_empty_tables(spark, planted, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{planted}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def same(df, sql, sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    other = con.execute(sql)
    names = [d[0] for d in other.description]
    norm = lambda rows: sorted(tuple("~" if v is None or v != v else str(v) for v in r) for r in rows)
    return set(names) == set(df.columns) and norm(df.select(*names).collect()) == norm(other.fetchall())


@pytest.mark.parametrize("name", [k for k in entry.oracle_sql() if k.startswith("op")])
def test_sql_twins(spark, sf, name):
    assert same(entry.queries()[name](spark, sf), entry.oracle_sql()[name], sf)


def test_contract_columns(spark, sf):
    want = {
        "op1": "doc_id held_out lang_pred score", "op2": "doc_id n_shingles component_id", "op3": "vec_id n_links component_id kept", "op4": "page_id host path rule verdict",
        "op5": "doc_id held_out score predicted", "op6": "doc_id", "op7": "doc_id held_out score predicted", "op8": "doc_id size source_size target taken",
        "op9": "doc_id size text_crc32 law shard slot grown_shard", "op10": "doc_id contaminated item_id",
        "op11": "doc_id start n_tokens ids_crc32", "op12": "vec_id code error label_error codebooks_sha256",
        "op13": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    }
    names = {k.split("_")[0]: k for k in entry.queries() if k.startswith("op")}
    assert set(names) == set(want) and "pipeline" in entry.queries()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    total = sum(len(words(r.text)) for r in docs.collect())
    for k, columns in want.items():
        df = entry.queries()[names[k]](spark, sf)
        assert set(columns.split()) <= set(df.columns), k
        if k in ("op1", "op2", "op5", "op7", "op8", "op9", "op10", "op11"):
            assert df.count() == docs.count(), k
        if k == "op8":
            assert df.agg(F.sum("size")).first()[0] == total
